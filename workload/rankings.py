"""Distances, scaling and whole rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from echorank.functions.distances import euclidean, euclidean_mfcc, sym_kl
from echorank.functions.gaussian import gaussian_terms
from echorank.functions.ids import as_column
from echorank.operators.filters import above_mean, below_mean, by_id, finite
from echorank.operators.joins import assemble_features, fuse_join
from echorank.operators.ordering import top_k, with_position
from echorank.operators.pairing import ALL_FEATURES, DISTANCES, distance_pairs, load_queries
from echorank.operators.scaling import global_stats, minmax_scale
from echorank.plans import ranking as R
from echorank.plans.refine import BH_FIRST, CHROMA_FIRST, rank_filter_refine

from .catalogue import DISTANCE_SQL, SONG, SONGS, TABLES_SQL, feature_tables, rounded, vectors, wide_table
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _in(songs) -> str:
    return ", ".join(f"'{s}'" for s in songs)


def _dist(features) -> str:
    return ",\n  ".join(f"{DISTANCE_SQL[DISTANCES[f].column]} AS {DISTANCES[f].column}" for f in features)


def _scaled(f: str, low: str, high: str) -> str:
    d = DISTANCES[f]
    value = f"({d.column} - {low}) / nullif({high} - {low}, 0)"
    return f"1 - {value}" if d.larger_is_closer else value


def merged_sql(features, songs, tail: str) -> str:
    """Complete rows first, bounds per query after the finite filter."""
    columns = [DISTANCES[f].column for f in features]
    finite_sql = " AND ".join(f"{DISTANCES[f].column} < CAST('inf' AS DOUBLE)" for f in features if DISTANCES[f].drops_infinite)
    scaled = ", ".join(
        f"{_scaled(f, f'min({DISTANCES[f].column}) OVER w', f'max({DISTANCES[f].column}) OVER w')} AS {DISTANCES[f].scaled}"
        for f in features
    )
    total = " + ".join(DISTANCES[f].scaled for f in features)
    return f"""WITH {TABLES_SQL},
wide AS (SELECT * FROM feat JOIN nts USING (id)),
d AS (SELECT q.id AS query_id, x.id, x.key, x.scale, x.bpm, {_dist(features)}
      FROM wide x JOIN wide q ON q.id IN ({_in(songs)})),
f AS (SELECT * FROM d WHERE {finite_sql or 'true'}),
s AS (SELECT query_id, id, key, scale, bpm, {', '.join(columns)}, {scaled} FROM f WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT *, ({total}) / {len(features)} AS aggregated FROM s)
{tail}"""


def full_sql(features, song: str, tail: str) -> str:
    """Every distance scaled over its own table, then joined."""
    parts, joins = [], []
    for f in features:
        d = DISTANCES[f]
        source = "nts" if f == "notes" else "feat"
        labels = {"notes": "x.key, x.scale, ", "bh": "x.bpm, "}.get(f, "")
        keep = f"WHERE {d.column} < CAST('inf' AS DOUBLE)" if d.drops_infinite else ""
        parts.append(
            f"d_{f} AS (SELECT x.id, {labels}{DISTANCE_SQL[d.column]} AS {d.column} FROM {source} x "
            f"JOIN {source} q ON q.id = '{song}'),\n"
            f"s_{f} AS (SELECT *, {_scaled(f, f'min({d.column}) OVER ()', f'max({d.column}) OVER ()')} AS {d.scaled} "
            f"FROM d_{f} {keep})"
        )
        joins.append(f"s_{f}")
    total = " + ".join(DISTANCES[f].scaled for f in features)
    chain = joins[0] + "".join(f" JOIN {j} USING (id)" for j in joins[1:])
    return f"WITH {TABLES_SQL},\n" + ",\n".join(parts) + (
        f",\nr AS (SELECT *, ({total}) / {len(features)} AS aggregated FROM {chain})\n{tail}"
    )


def _columns(features, labels=("key", "scale", "bpm")) -> str:
    scores = ", ".join(f"round({DISTANCES[f].scaled}, 6) AS {DISTANCES[f].scaled}" for f in features)
    return ", ".join(["id", *labels, scores, "round(aggregated, 6) AS aggregated"])


def _scores(features) -> list[str]:
    return [*[DISTANCES[f].scaled for f in features], "aggregated"]


# --- distances --------------------------------------------------------------


def _one_distance(feature: str):
    d = DISTANCES[feature]
    source = "nts" if feature == "notes" else "feat"
    sql = f"""WITH {TABLES_SQL}
SELECT q.id AS query_id, x.id, round({DISTANCE_SQL[d.column]}, 6) AS {d.column}
FROM {source} x JOIN {source} q ON q.id IN ({_in(SONGS)})"""

    @register(f"dist_{feature}", sql)
    def run(spark, sf_dir):
        table = feature_tables(spark, sf_dir)[d.source]
        queries = load_queries(table, SONGS, [d.source])
        return rounded(distance_pairs(table, queries, [feature]), d.column)


for _feature in ("rp", "rh", "bh", "notes", "chroma", "skl", "js", "mfcc"):
    _one_distance(_feature)


@register(
    "native_distances",
    f"""WITH {TABLES_SQL}
SELECT x.id, round({DISTANCE_SQL['distances_rp']}, 6) AS l2, round({DISTANCE_SQL['distances_mfcc']}, 6) AS l2_model,
  round({DISTANCE_SQL['distances_skl']}, 6) AS skl, true AS invertible
FROM feat x JOIN vec v ON v.id = x.id JOIN feat q ON q.id = 'song' || v.label""",
)
def native_distances(spark, sf_dir):
    """Column-to-column forms on a pair table: every item with the first of its label number."""
    tables = feature_tables(spark, sf_dir)
    both = assemble_features([tables["rp"], tables["mfcc"]], dedupe=False).withColumn("t", gaussian_terms("mfcc"))
    labelled = both.join(vectors(spark, sf_dir).select("id", F.concat(F.lit("song"), "label").alias("q_id")), "id")
    asked = both.select(*[F.col(c).alias(f"q_{c}") for c in ("id", "rp", "mfcc", "t")])
    pairs = labelled.join(asked, "q_id")
    return pairs.select(
        "id",
        F.round(euclidean("rp", "q_rp"), 6).alias("l2"),
        F.round(euclidean_mfcc("mfcc", "q_mfcc", 2), 6).alias("l2_model"),
        F.round(sym_kl("mfcc", "q_mfcc", "t", "q_t", 2), 6).alias("skl"),
        as_column("t")["invertible"].alias("invertible"),
    )




@register(
    "chroma_xcorr_2d",
    f"""WITH {TABLES_SQL}, pairs AS (
  SELECT q.id AS query_id, x.id, q.chroma AS qc, x.chroma AS xc FROM feat x JOIN feat q ON q.id = '{SONG}'),
shifts AS (
  SELECT query_id, id, dr, dc,
    list_sum(list_transform(range(0, 12), lambda r: CASE WHEN r + dr < 0 OR r + dr > 11 THEN 0
      WHEN dc = 0 THEN qc[2*(r+dr)+1] * xc[2*r+1] + qc[2*(r+dr)+2] * xc[2*r+2]
      ELSE qc[2*(r+dr)+1] * xc[2*r+2] END)) AS s
  FROM pairs, generate_series(-6, 5) a(dr), generate_series(-1, 0) b(dc))
SELECT query_id, id, round(max(s), 6) AS distances_corr FROM shifts GROUP BY ALL""",
)
def chroma_xcorr_2d(spark, sf_dir):
    table = feature_tables(spark, sf_dir)["chroma"]
    queries = load_queries(table, [SONG], ["chroma"])
    return rounded(distance_pairs(table, queries, ["chroma"], chroma_variant="2d"), "distances_corr")


@register(
    "chroma_xcorr_full",
    f"""WITH {TABLES_SQL}, pairs AS (
  SELECT q.id AS query_id, x.id, q.chroma AS qc, x.chroma AS xc FROM feat x JOIN feat q ON q.id = '{SONG}'),
cell AS (
  SELECT query_id, id, di, dj,
    list_sum(list_transform(range(0, 24), lambda k: CASE
      WHEN k // 12 + di < 0 OR k // 12 + di > 1 OR k % 12 + dj < 0 OR k % 12 + dj > 11 THEN 0
      ELSE qc[(k // 12 + di) * 12 + k % 12 + dj + 1] * xc[k + 1] END)) AS s
  FROM pairs, generate_series(-1, 1) a(di), generate_series(-11, 11) b(dj)),
line AS (
  SELECT query_id, id, dj, max(s) AS top, max(s) FILTER (di = -1) AS s0, max(s) FILTER (di = 0) AS s1, max(s) FILTER (di = 1) AS s2
  FROM cell GROUP BY query_id, id, dj QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY top DESC, dj) = 1),
pass AS (SELECT query_id, id, s0, s1, s2, 1 / (1 + tan(pi() * 0.05)) AS g, (1 - tan(pi() * 0.05)) / (1 + tan(pi() * 0.05)) AS f FROM line)
SELECT query_id, id, round(greatest(g * s0, g * (s1 - s0) + f * g * s0, g * (s2 - s1) + f * (g * (s1 - s0) + f * g * s0)), 6) AS distances_corr
FROM pass""",
)
def chroma_xcorr_full(spark, sf_dir):
    table = feature_tables(spark, sf_dir)["chroma"]
    queries = load_queries(table, [SONG], ["chroma"])
    return rounded(distance_pairs(table, queries, ["chroma"], chroma_variant="full"), "distances_corr")


# --- scaling, filters ---------------------------------------------------------


def _rh_pairs(spark, sf_dir):
    table = feature_tables(spark, sf_dir)["rh"]
    return distance_pairs(table, load_queries(table, [SONG], ["rh"]), ["rh"])


_RH_SQL = f"""WITH {TABLES_SQL},
d AS (SELECT x.id, {DISTANCE_SQL['distances_rh']} AS d FROM feat x JOIN feat q ON q.id = '{SONG}')"""


@register(
    "global_stats",
    merged_sql(
        ALL_FEATURES,
        SONGS,
        "SELECT query_id, "
        + ", ".join(
            f"round({sql}({DISTANCES[f].column}), 6) AS {name}_{DISTANCES[f].column}"
            for f in ALL_FEATURES
            for name, sql in (("min", "min"), ("max", "max"), ("mean", "avg"), ("stddev", "stddev_samp"))
        )
        + " FROM r GROUP BY query_id",
    ),
)
def global_stats_query(spark, sf_dir):
    pairs = R.wide_distances(wide_table(spark, sf_dir), SONGS)
    stats = global_stats(pairs, [DISTANCES[f].column for f in ALL_FEATURES], ["query_id"])
    return rounded(stats, *[c for c in stats.columns if c != "query_id"])


@register(
    "minmax_scale",
    _RH_SQL + " SELECT id, round((d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS scaled,"
    " round(1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()), 6) AS inverted FROM d",
)
def minmax_scale_query(spark, sf_dir):
    scaled = minmax_scale(_rh_pairs(spark, sf_dir), "distances_rh", "scaled")
    both = minmax_scale(scaled, "distances_rh", "inverted", inverted=True)
    return rounded(both.select("id", "scaled", "inverted"), "scaled", "inverted")


@register("below_mean", _RH_SQL + " SELECT id, round(d, 6) AS distances_rh FROM d WHERE d < (SELECT avg(d) FROM d)")
def below_mean_query(spark, sf_dir):
    return rounded(below_mean(_rh_pairs(spark, sf_dir), "distances_rh").select("id", "distances_rh"), "distances_rh")


@register("above_mean", _RH_SQL + " SELECT id, round(d, 6) AS distances_rh FROM d WHERE d > (SELECT avg(d) FROM d)")
def above_mean_query(spark, sf_dir):
    return rounded(above_mean(_rh_pairs(spark, sf_dir), "distances_rh").select("id", "distances_rh"), "distances_rh")


@register(
    "finite_js",
    f"""WITH {TABLES_SQL}, d AS (SELECT x.id, {DISTANCE_SQL['distances_js']} AS d FROM feat x JOIN feat q ON q.id = '{SONG}')
SELECT id, round(d, 6) AS distances_js FROM d WHERE d < CAST('inf' AS DOUBLE)""",
)
def finite_js(spark, sf_dir):
    table = feature_tables(spark, sf_dir)["mfcc"]
    pairs = distance_pairs(table, load_queries(table, [SONG], ["mfcc"]), ["js"])
    return rounded(finite(pairs, "distances_js").select("id", "distances_js"), "distances_js")


@register("by_id", f"WITH {TABLES_SQL} SELECT id, key, scale, notes FROM nts WHERE id = '{SONG}'")
def by_id_query(spark, sf_dir):
    return by_id(feature_tables(spark, sf_dir)["notes"], SONG)


# --- rankings -------------------------------------------------------------------


@register("rank_full", full_sql(ALL_FEATURES, SONG, f"SELECT {_columns(ALL_FEATURES)} FROM r"))
def rank_full(spark, sf_dir):
    return rounded(R.rank_full(feature_tables(spark, sf_dir), SONG), *_scores(ALL_FEATURES))


@register("rank_fast", full_sql(R.FAST, SONG, f"SELECT {_columns(R.FAST, ('key', 'scale'))} FROM r"))
def rank_fast(spark, sf_dir):
    return rounded(R.rank_fast(feature_tables(spark, sf_dir), SONG), *_scores(R.FAST))


@register("rank_precise", full_sql(R.PRECISE, SONG, f"SELECT {_columns(R.PRECISE, ())} FROM r"))
def rank_precise(spark, sf_dir):
    return rounded(R.rank_precise(feature_tables(spark, sf_dir), SONG), *_scores(R.PRECISE))


@register("rank_merged", merged_sql(ALL_FEATURES, [SONG], f"SELECT {_columns(ALL_FEATURES)} FROM r"))
def rank_merged(spark, sf_dir):
    return rounded(R.rank_merged(wide_table(spark, sf_dir), SONG), *_scores(ALL_FEATURES))


@register(
    "rank_without_nan",
    f"""WITH {TABLES_SQL},
d AS (SELECT x.id, {DISTANCE_SQL['distances_rp']} AS a, {DISTANCE_SQL['distances_rh']} AS b FROM feat x JOIN feat q ON q.id = '{SONG}'
  WHERE x.id IN (SELECT id FROM nts) AND (right(x.id, 1) <> '3' OR x.id = '{SONG}')),
s AS (SELECT id, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS a, (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS b FROM d)
SELECT id, round((a + b) / 2, 6) AS aggregated FROM s""",
)
def rank_without_nan(spark, sf_dir):
    """One number of some vectors is not a number: these items drop out, the others keep their scores."""
    spoiled = F.concat(F.slice("rp", 1, 3), F.array(F.lit(float("nan"))), F.slice("rp", 5, 1 << 20))
    bad = (F.right("id", F.lit(1)) == "3") & (F.col("id") != SONG)
    wide = wide_table(spark, sf_dir).withColumn("rp", F.when(bad, spoiled).otherwise(F.col("rp")))
    return rounded(R.rank_merged(wide, SONG, ["rp", "rh"]).select("id", "aggregated"), "aggregated")


_SCORE_LIST = ", ".join(f"round({DISTANCES[f].scaled}, 6) AS score_{f}" for f in R.SCORE_ORDER)


@register("rank_scores", full_sql(R.SCORE_ORDER, SONG, f"SELECT id, {_SCORE_LIST}, round(aggregated, 6) AS mean FROM r"))
def rank_scores(spark, sf_dir):
    scores = R.rank_scores(feature_tables(spark, sf_dir), SONG)
    parts = [F.round(F.col("scores")[n], 6).alias(f"score_{f}") for n, f in enumerate(R.SCORE_ORDER)]
    return scores.select("id", *parts, F.round("mean", 6).alias("mean"))


_LEXICOGRAPHIC = ", ".join(DISTANCES[f].scaled for f in R.SCORE_ORDER)


@register(
    "rank_lexicographic",
    full_sql(R.SCORE_ORDER, SONG, f"SELECT id, round(aggregated, 6) AS mean FROM r ORDER BY {_LEXICOGRAPHIC}, id LIMIT 10"),
)
def rank_lexicographic(spark, sf_dir):
    ordered = R.rank_scores(feature_tables(spark, sf_dir), SONG, lexicographic=True)
    return ordered.limit(10).select("id", F.round("mean", 6).alias("mean"))


@register(
    "rank_batch",
    merged_sql(ALL_FEATURES, SONGS, f"SELECT query_id, {_columns(ALL_FEATURES)} FROM r"),
)
def rank_batch(spark, sf_dir):
    return rounded(R.rank_batch(wide_table(spark, sf_dir), SONGS), *_scores(ALL_FEATURES))


def _fast_rows(song: str) -> str:
    tail = f"SELECT '{song}' AS query_id, {_columns(R.FAST, ('key', 'scale'))} FROM r"
    return f"SELECT * FROM ({full_sql(R.FAST, song, tail)})"


@register("rank_full_batch", " UNION ALL ".join(_fast_rows(song) for song in SONGS[:3]))
def rank_full_batch(spark, sf_dir):
    return rounded(R.rank_full_batch(feature_tables(spark, sf_dir), SONGS[:3], R.FAST), *_scores(R.FAST))


@register(
    "fuse_join",
    f"""WITH {TABLES_SQL},
a AS (SELECT x.id, {DISTANCE_SQL['distances_rp']} AS distances_rp FROM feat x JOIN feat q ON q.id = '{SONG}'),
b AS (SELECT x.id, {DISTANCE_SQL['distances_rh']} AS distances_rh FROM feat x JOIN feat q ON q.id = '{SONG}'),
c AS (SELECT x.id, x.key, x.scale, {DISTANCE_SQL['distances_levenshtein']} AS distances_levenshtein FROM nts x JOIN nts q ON q.id = '{SONG}')
SELECT id, key, scale, round(distances_rp, 6) AS distances_rp, round(distances_rh, 6) AS distances_rh, distances_levenshtein
FROM a JOIN b USING (id) JOIN c USING (id)""",
)
def fuse_join_query(spark, sf_dir):
    """Three distance tables by id; the whole-row copies of one of them collapse."""
    tables = feature_tables(spark, sf_dir)
    parts = []
    for name, keep in (("rp", ()), ("rh", ()), ("notes", ("key", "scale"))):
        queries = load_queries(tables[name], [SONG], [name])
        parts.append(distance_pairs(tables[name], queries, [name], keep).drop("query_id"))
    parts[1] = parts[1].union(parts[1])
    return rounded(fuse_join(parts), "distances_rp", "distances_rh")


@register(
    "top_k",
    merged_sql(ALL_FEATURES, [SONG], "SELECT id, round(aggregated, 6) AS aggregated FROM r ORDER BY r.aggregated, id LIMIT 20"),
)
def top_k_query(spark, sf_dir):
    ranked = R.rank_merged(wide_table(spark, sf_dir), SONG).select("id", "aggregated")
    return rounded(top_k(ranked, 20), "aggregated")


_POSITION = "row_number() OVER (PARTITION BY query_id ORDER BY r.aggregated, id)"


@register(
    "top_k_per_query",
    merged_sql(
        ALL_FEATURES,
        SONGS,
        f"SELECT query_id, id, round(aggregated, 6) AS aggregated FROM r QUALIFY {_POSITION} <= 10",
    ),
)
def top_k_per_query(spark, sf_dir):
    ranked = R.rank_batch(wide_table(spark, sf_dir), SONGS, store=False).select("query_id", "id", "aggregated")
    return rounded(top_k(ranked, 10, by=["query_id"]), "aggregated")


@register(
    "ranking_positions",
    merged_sql(ALL_FEATURES, SONGS, f"SELECT query_id, id, {_POSITION} - 1 AS position FROM r"),
)
def ranking_positions(spark, sf_dir):
    ranked = R.rank_batch(wide_table(spark, sf_dir), SONGS).select("query_id", "id", "aggregated")
    return with_position(ranked, by=["query_id"]).select("query_id", "id", "position")


def refine_sql(order, labels=("key", "scale", "bpm")) -> str:
    """One CTE per step."""
    steps, previous, scaled = [], "d", []
    for n, f in enumerate(order):
        d = DISTANCES[f]
        finite_sql = f"WHERE {d.column} < CAST('inf' AS DOUBLE)" if d.drops_infinite else ""
        steps.append(
            f"a{n} AS (SELECT *, min({d.column}) OVER () AS lo{n}, max({d.column}) OVER () AS hi{n}, "
            f"avg({d.column}) OVER () AS av{n} FROM {previous} {finite_sql}),\n"
            f"s{n} AS (SELECT *, {_scaled(f, f'lo{n}', f'hi{n}')} AS {d.scaled} FROM a{n} "
            f"WHERE {d.column} {'>' if d.larger_is_closer else '<'} av{n})"
        )
        previous = f"s{n}"
        scaled.append(d.scaled)
    return f"""WITH {TABLES_SQL},
wide AS (SELECT * FROM feat JOIN nts USING (id)),
d AS (SELECT x.id, x.key, x.scale, x.bpm, {_dist(order)} FROM wide x JOIN wide q ON q.id = '{SONG}'),
{', '.join(steps)},
r AS (SELECT *, ({' + '.join(scaled)}) / {len(order)} AS aggregated FROM {previous})
SELECT {_columns(order, labels)} FROM r"""


def _refine(name: str, order, labels=("key", "scale", "bpm")):
    @register(name, refine_sql(order, labels))
    def run(spark, sf_dir):
        return rounded(rank_filter_refine(wide_table(spark, sf_dir), SONG, order), *_scores(order))


_refine("rank_filter_refine_chroma_first", CHROMA_FIRST)
_refine("rank_filter_refine_bh_first", BH_FIRST)
_refine("rank_filter_refine_three", ("rh", "rp", "mfcc"), labels=())


@register(
    "assemble_features",
    f"WITH {TABLES_SQL} SELECT id, key, scale, bpm, notes, rp, rh, bh FROM feat JOIN nts USING (id)",
)
def assemble_query(spark, sf_dir):
    tables = feature_tables(spark, sf_dir)
    wide = assemble_features([tables[s] for s in ("chroma", "mfcc", "notes", "rp", "rh", "bh")])
    return wide.select("id", "key", "scale", "bpm", "notes", "rp", "rh", "bh")


@register("row_count", f"WITH {TABLES_SQL} SELECT count(*) AS items FROM feat JOIN nts USING (id)")
def row_count(spark, sf_dir):
    return wide_table(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"))
