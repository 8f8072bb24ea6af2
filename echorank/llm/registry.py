"""The registry of this subpackage's queries and their SQL."""

from workload.registry import Registry

query = Registry()
