"""Writers. All of them write from the executors, one folder of part files each."""
