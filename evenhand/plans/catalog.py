"""Queries of the engine with their DuckDB twins.

The twins say the same in SQL from scratch; both sides round to six places in the output only.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.operators import comparison, ensemble, evaluation, hardness, neighbours, sampling
from evenhand.operators.learners import Forest, NaiveBayes, NearestCentroid, Tree
from evenhand.operators.trees import BINS, MAX_DEPTH
from evenhand.sources.frame import canonical, doc_table, embedding_table, imbalanced
from evenhand.sources.staging import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}
MEMBERS, SEED = 5, 42


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def flat(df: DataFrame, width: int = 3) -> DataFrame:
    """features as rounded columns f0, f1, ..."""
    return df.select(*(c for c in df.columns if c != "features"), *(F.round(F.col("features")[i], 6).alias(f"f{i}") for i in range(width)))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return canonical(rows, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")


# ---- SQL parts ----
DOC = "doc AS (SELECT l.doc_id AS row_id, l.toxic AS label, [d.n_chars::DOUBLE, (length(d.text) - length(replace(d.text, ' ', '')))::DOUBLE, l.quality::DOUBLE] AS features FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
EMB = "doc AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS features FROM embeddings)"
EMB2 = "doc AS (SELECT vec_id AS row_id, (label < 2)::INT AS label, embedding::DOUBLE[] AS features FROM embeddings)"
LI = "doc AS (SELECT l_orderkey AS row_id, l_returnflag AS label, [l_quantity, l_extendedprice, l_discount, l_tax] AS features FROM lineitem)"
CELLS = "cells AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) - 1 AS pos FROM doc), ranges AS (SELECT pos, min(v) AS low, max(v) AS high FROM cells GROUP BY pos)"
OVERLAP = (
    CELLS + ", scaled AS (SELECT row_id, label, pos, CASE WHEN high > low THEN (v - low) / (high - low) ELSE 0e0 END AS s FROM cells JOIN ranges USING (pos))"
    ", cent AS (SELECT label, pos, avg(s) AS g FROM scaled GROUP BY label, pos)"
    ", away AS (SELECT s.row_id, s.label, c.label AS other, sqrt(sum((s.s - c.g) * (s.s - c.g))) AS d FROM scaled s JOIN cent c ON s.pos = c.pos AND s.label <> c.label GROUP BY s.row_id, s.label, c.label)"
    ", raw AS (SELECT row_id, label, 1 / (1 + min(d)) AS r FROM away GROUP BY row_id, label)"
    ", hard AS (SELECT row_id, label, CASE WHEN max(r) OVER () > min(r) OVER () THEN (r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ()) ELSE 1e0 / count(*) OVER () END AS complexity FROM raw)"
)
COUNTS = "counts AS (SELECT label, count(*) AS n FROM doc GROUP BY label)"
TARGET = COUNTS + ", tgt AS (SELECT CAST(sum(n) // count(*) AS BIGINT) AS t FROM counts)"


def u_sql(purpose: str, key: str) -> str:
    return f"((('0x' || substr(md5('{SEED}:{purpose}:' || {key}), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"


def knn_sql(k: int) -> str:
    return f"near AS (SELECT a.row_id AS query_id, b.row_id, a.label AS own, b.label, list_distance(a.features, b.features) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), b.row_id) AS rk FROM doc a JOIN doc b ON a.row_id <> b.row_id QUALIFY rk <= {k})"


def resample_sql(mu: str, sigma: float = 0.2, k: int = 3, members: int | None = None, grid: str = "", b: str = "member_id, ") -> str:
    """CTEs that end in ``real`` and ``made``; with members (or a grid of b and mu) by member_id (or b) and their mu."""
    grid = f", grid AS (SELECT i::INT AS member_id, i / {members - 1}e0 AS mu FROM range({members}) r(i))" if members else grid and f", grid AS ({grid})"
    members, b = bool(grid), b if grid else ""
    bj = f"{b}label"
    rng = f"greatest(exp(-0.5e0 * pow((complexity - {mu}) / {sigma}e0, 2)) / ({sigma}e0 * sqrt(2 * pi())), 1e-10)"
    return (
        f"{TARGET}{grid}, w AS (SELECT {b}h.row_id, h.label, doc.features, {rng} AS weight FROM hard h JOIN doc USING (row_id){' CROSS JOIN grid' if members else ''})"
        f", ranked AS (SELECT {b}w.row_id, label, features, row_number() OVER (PARTITION BY {bj} ORDER BY -ln({u_sql('under', 'row_id')}) / weight, row_id) AS rk FROM w)"
        ", real AS (SELECT ranked.* FROM ranked, tgt WHERE rk <= t)"
        f", short AS (SELECT {b}label, t - count(*) AS missing, least({k}, count(*)) AS kk FROM w, tgt GROUP BY {b}label, t HAVING count(*) < t)"
        f", slots AS (SELECT {b}label, kk, unnest(range(1, missing + 1)) AS slot FROM short)"
        f", bl AS (SELECT {b}label, row_id, weight, floor({u_sql('range', 'row_id')} * 64)::INT AS block FROM w)"
        f", bs AS (SELECT {b}label, block, sum(weight) AS s FROM bl GROUP BY {b}label, block)"
        f", be AS (SELECT {b}label, block, sum(s) OVER (PARTITION BY {bj} ORDER BY block ROWS UNBOUNDED PRECEDING) AS e FROM bs)"
        f", bb AS (SELECT {b}label, block, e, lag(e, 1, 0e0) OVER (PARTITION BY {bj} ORDER BY block) AS begin_, max(e) OVER (PARTITION BY {bj}) AS total FROM be)"
        f", asked AS (SELECT {b}label, slot, kk, max(block) AS block, arg_max(x - begin_, block) AS pos FROM (SELECT {b}label, slot, kk, block, begin_, {u_sql('seed', chr(39) + chr(39) + ' || label || ' + chr(39) + ':' + chr(39) + ' || slot')} * total AS x FROM slots JOIN bb USING ({bj})) WHERE begin_ <= x GROUP BY {b}label, slot, kk)"
        f", cum AS (SELECT {b}label, block, row_id, sum(weight) OVER (PARTITION BY {bj}, block ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS c FROM bl)"
        f", st AS (SELECT {b}label, block, row_id, lag(c, 1, 0e0) OVER (PARTITION BY {bj}, block ORDER BY row_id) AS p0 FROM cum)"
        f", drawn AS (SELECT {b}label, slot, kk, arg_max(row_id, p0) AS seed_row_id FROM asked JOIN st USING ({bj}, block) WHERE p0 <= pos GROUP BY {b}label, slot, kk)"
        ", cand AS (SELECT a.row_id AS seed_row_id, b.row_id AS neighbor_row_id, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), a.row_id <> b.row_id, b.row_id) AS rk FROM (SELECT DISTINCT seed_row_id AS row_id FROM drawn) d JOIN doc a USING (row_id) JOIN doc b ON a.label = b.label)"
        f", made AS (SELECT {', '.join('d.' + c.strip() for c in bj.split(','))}, d.slot, d.seed_row_id, c.neighbor_row_id, alpha, a.features AS fa, z.features AS fb FROM (SELECT *, {u_sql('alpha', 'label || ' + chr(39) + ':' + chr(39) + ' || slot')} AS alpha, floor({u_sql('nbr', 'label || ' + chr(39) + ':' + chr(39) + ' || slot')} * kk) + 1 AS pick FROM drawn) d JOIN cand c ON c.seed_row_id = d.seed_row_id AND c.rk = d.pick JOIN doc a ON a.row_id = d.seed_row_id JOIN doc z ON z.row_id = c.neighbor_row_id)"
    )


#: The bag of ``real`` and ``made`` by b.
def bag_sql(b: str = "member_id, ", more: str = "") -> str:
    """``bag``; more: names of further columns, row_id and slot."""
    m = "".join(f", {c.strip()}" for c in more.split(",") if c.strip())
    absent = m.replace("slot", "NULL::BIGINT AS slot")
    return f"bag AS (SELECT {b}label, features{absent} FROM real UNION ALL SELECT {b}label, list_transform(range(1, len(fa) + 1), lambda i: fa[i] + alpha * (fb[i] - fa[i])){m.replace('row_id', 'NULL')} FROM made)"


def tree_sql(name: str, rows: str, b: str = "", tried: int | None = None) -> str:
    """``name``: p of the classes in the leaf that each row of ``rows`` with w = 0 comes to, in trees that those with w > 0 grow, one
    for each b. Nodes split in a recursion: each step finds ranges, bins and scores of all nodes and moves the rows down."""
    u = f"{b}node"
    tree = " || ':' || ".join(c.strip() for c in u.split(","))
    few = f" QUALIFY row_number() OVER (PARTITION BY {u} ORDER BY {u_sql('features', tree + chr(32) + '||' + chr(39) + ':' + chr(39) + '|| (pos - 1)')}, pos) <= {tried}" if tried else ""
    binned = lambda v: f"least({BINS - 1}, floor(({v} - low) / (high - low) * {BINS}))::INT"
    own = "".join(f"z.{c.strip()}, " for c in b.split(",") if c.strip())
    return (
        f"{name}_g AS (SELECT {b}row_id, label, features, w, 1::BIGINT AS node, 0 AS depth FROM {rows} UNION ALL SELECT * FROM ("
        f"WITH c AS (SELECT {u}, label, w, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM {name}_g WHERE w > 0 AND depth < {MAX_DEPTH})"
        f", impure AS (SELECT {u} FROM c GROUP BY {u} HAVING count(DISTINCT label) > 1)"
        f", r0 AS (SELECT {u}, pos, min(v) AS low, max(v) AS high FROM c JOIN impure USING ({u}) GROUP BY {u}, pos HAVING max(v) > min(v))"
        f", r AS (SELECT * FROM r0{few})"
        f", h AS (SELECT {u}, pos, label, {binned('v')} AS bin, sum(w)::BIGINT AS n FROM c JOIN r USING ({u}, pos) GROUP BY {u}, pos, label, bin)"
        f", t AS (SELECT {u}, pos, label, sum(n)::BIGINT AS t FROM h GROUP BY {u}, pos, label)"
        f", cuts AS (SELECT DISTINCT {u}, pos, bin + 1 AS cut FROM h)"
        f", lr AS (SELECT {u}, pos, cut, label, coalesce(sum(n) FILTER (bin < cut), 0)::BIGINT AS l, any_value(t) AS t FROM cuts JOIN t USING ({u}, pos) LEFT JOIN h USING ({u}, pos, label) GROUP BY {u}, pos, cut, label)"
        f", s AS (SELECT {u}, pos, cut, sum(l * l)::DOUBLE / sum(l) + sum((t - l) * (t - l))::DOUBLE / sum(t - l) AS score FROM lr GROUP BY {u}, pos, cut HAVING sum(t - l) > 0)"
        f", best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {u} ORDER BY score DESC, pos, cut) = 1)"
        f" SELECT {own}z.row_id, z.label, z.features, z.w, 2 * z.node + ({binned('z.features[pos]')} >= cut)::INT, z.depth + 1 FROM {name}_g z JOIN best USING ({u}) JOIN r USING ({u}, pos)))"
        f", {name}_last AS (SELECT {b}row_id, label, arg_max(node, depth) AS node FROM {name}_g WHERE w = 0 GROUP BY {b}row_id, label)"
        f", {name}_counts AS (SELECT {u}, label AS class, sum(w) AS n FROM {name}_g WHERE w > 0 GROUP BY {u}, label)"
        f", {name} AS (SELECT {b}row_id, label, class, n / sum(n) OVER (PARTITION BY {b}row_id, label)::DOUBLE AS p FROM {name}_last JOIN {name}_counts USING ({u}))"
    )


def forest_sql(name: str, rows: str, trees: int, b: str = "", tried: int | None = 2) -> str:
    """``name``: p of a forest; ``rows`` have b, row_id, slot (null without one), label, features and w: 1 to train, 0 to be scored."""
    at, part, steps = 0.0, exp(-1.0), []
    for n in range(1, 12):
        at += part
        part /= n
        steps.append(f"(u >= {at!r}e0)::INT" if "e" not in repr(at) else f"(u >= {at!r})::INT")
    key = "tree || coalesce(':' || row_id, '') || coalesce(':' || slot, '')"
    return (
        f"{name}_in AS (SELECT tree, * EXCLUDE (w, slot, u), CASE WHEN w = 0 THEN 0 ELSE {' + '.join(steps)} END AS w FROM (SELECT *, {u_sql('bag', key)} AS u FROM {rows}, range({trees}) t(tree)) WHERE w = 0 OR {' + '.join(steps)} > 0)"
        f", {tree_sql(name + '_all', name + '_in', b + 'tree, ', tried)}"
        f", {name} AS (SELECT {b}row_id, label, class, round(sum(p) / {trees}, 12) AS p FROM {name}_all GROUP BY {b}row_id, label, class)"
    )


def pred_sql(name: str, proba: str, b: str = "") -> str:
    return f"{name} AS (SELECT {b}row_id, label, class AS pred FROM {proba} QUALIFY row_number() OVER (PARTITION BY {b}row_id, label ORDER BY p DESC, class) = 1)"


def soft_sql(name: str, proba: str, members: str, b: str = "") -> str:
    """``name`` (p) of the members' p in ``proba``."""
    return f"{name}_m AS (SELECT {b}row_id, label, class, round(sum(p) / {members}, 12) AS m FROM {proba} GROUP BY {b}row_id, label, class), {name} AS (SELECT {b}row_id, label, class, m / (sum(m) OVER (PARTITION BY {b}row_id, label) + 1e-10) AS p FROM {name}_m)"


def columns_sql(width: int, source: str) -> str:
    return ", ".join((f"round(fa[{i + 1}] + alpha * (fb[{i + 1}] - fa[{i + 1}]), 6) AS f{i}" if source == "made" else f"round(features[{i + 1}], 6) AS f{i}") for i in range(width))


def balanced_sql(b: str = "", width: int = 3) -> str:
    return (
        f"SELECT {b}label, row_id, NULL::BIGINT AS slot, false AS is_synthetic, NULL::BIGINT AS seed_row_id, NULL::BIGINT AS neighbor_row_id, {columns_sql(width, 'real')} FROM real"
        f" UNION ALL SELECT {b}label, NULL, slot, true, seed_row_id, neighbor_row_id, {columns_sql(width, 'made')} FROM made"
    )


def nc_sql(train: str, rows: str, b: str = "") -> str:
    """``proba``: p of the nearest-centroid learner fitted on ``train`` (features) for ``rows``."""
    on = "USING (pos)"
    return (
        f"tc AS (SELECT {b}label AS class, pos, avg(v) AS g FROM (SELECT {b}label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM {train}) GROUP BY {b}label, pos)"
        f", rc AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM {rows})"
        f", sc AS (SELECT {b}row_id, label, class, 1 / (1 + sqrt(sum((v - g) * (v - g)))) AS s FROM rc JOIN tc {on} GROUP BY {b}row_id, label, class)"
        f", proba AS (SELECT {b}row_id, label, class, s / sum(s) OVER (PARTITION BY {b}row_id) AS p FROM sc)"
    )


def bags_sql() -> str:
    return f"WITH {DOC}, {OVERLAP}, {resample_sql('mu', k=5, members=MEMBERS)}, {bag_sql()}"


# ---- classes and targets ----
@query("class_counts", f"WITH {DOC}, {COUNTS} SELECT label, n FROM counts")
def class_counts(spark, sf):
    return evaluation.class_counts(doc_table(spark, sf))


@query("class_ratio", f"WITH {DOC}, {COUNTS} SELECT round(max(n) / min(n)::DOUBLE, 6) AS ratio FROM counts")
def class_ratio(spark, sf):
    return rounded(evaluation.class_counts(doc_table(spark, sf)).agg((F.max("n") / F.min("n")).alias("ratio")), "ratio")


for _name, _sql in (("mean", "sum(n) // count(*)"), ("median", "floor(quantile_cont(n, 0.5))"), ("max", "max(n)"), ("min", "min(n)")):

    @query(f"target_{_name}", f"WITH {EMB}, {COUNTS} SELECT CAST({_sql} AS BIGINT) AS target FROM counts")
    def target(spark, sf, strategy=_name):
        return sampling.target_size(evaluation.class_counts(embedding_table(spark, sf)), strategy)


@query("class_info", f"WITH {DOC}, {TARGET} SELECT label, n, t AS target, (SELECT count(*) FROM counts) AS n_classes FROM counts, tgt")
def class_info(spark, sf):
    return sampling.class_info(doc_table(spark, sf))


# ---- features ----
@query("minmax_features", f"WITH {LI}, {CELLS} SELECT CAST(pos AS INT) AS pos, low, high FROM ranges")
def minmax_features(spark, sf):
    return hardness.feature_ranges(lineitems(spark, sf))


@query("class_centroids", f"WITH {LI}, {CELLS} SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 4) AS m FROM cells GROUP BY label, pos")
def class_centroids(spark, sf):
    return hardness.centroids(lineitems(spark, sf)).select("label", F.posexplode("centroid").alias("pos", "m")).withColumn("m", F.round("m", 4))


# ---- hardness ----
def hard(kind: str, table=doc_table, **options):
    return lambda spark, sf: rounded(hardness.REGISTRY[kind](table(spark, sf), **options), "complexity")


HARD = "SELECT row_id, label, round(complexity, 6) AS complexity FROM "
query("hardness_overlap", f"WITH {DOC}, {OVERLAP} {HARD} hard")(hard("overlap"))
query("hardness_overlap_multiclass", f"WITH {EMB}, {OVERLAP} {HARD} hard")(hard("overlap", embedding_table))
query("hardness_neighborhood", f"WITH {EMB}, {knn_sql(5)} SELECT query_id AS row_id, own AS label, round(avg((own <> label)::INT), 6) AS complexity FROM near GROUP BY query_id, own")(hard("neighborhood", embedding_table))
query("hardness_class_balance", f"WITH {EMB}, {COUNTS} SELECT row_id, label, round(1e0 / (SELECT count(*) FROM counts) - n / (SELECT sum(n) FROM counts)::DOUBLE, 6) AS complexity FROM doc JOIN counts USING (label)")(hard("class_balance", embedding_table))
query("hardness_minority_value", f"WITH {EMB}, {COUNTS} SELECT row_id, label, round(1 - n / (SELECT max(n) FROM counts)::DOUBLE, 6) AS complexity FROM doc JOIN counts USING (label)")(hard("minority_value", embedding_table))
query("hardness_n2", f"WITH {EMB2}, d AS (SELECT a.row_id, a.label, min(list_distance(a.features, b.features)) FILTER (a.label = b.label) AS f, min(list_distance(a.features, b.features)) FILTER (a.label <> b.label) AS e FROM doc a JOIN doc b ON a.row_id <> b.row_id GROUP BY a.row_id, a.label) SELECT row_id, label, round(coalesce(f / nullif(e, 0) / (1 + f / nullif(e, 0)), 1), 6) AS complexity FROM d")(hard("n2", lambda s, d: embedding_table(s, d, True)))
SETS = (
    "pairs AS (SELECT a.row_id AS i, b.row_id AS j, a.label = b.label AS same, list_distance(a.features, b.features) AS d FROM doc a JOIN doc b ON a.row_id <> b.row_id)"
    f", {COUNTS}, enemies AS (SELECT i, min(d) FILTER (NOT same) AS e, arg_min(j, (d, j)) FILTER (NOT same) AS enemy, max(d) FILTER (same) AS far FROM pairs GROUP BY i)"
    ", sets AS (SELECT i, j FROM pairs JOIN enemies USING (i) WHERE same AND d < e)"
)
_emb2 = lambda s, d: embedding_table(s, d, True)
for _kind, _sql in (
    ("lsc", "1 - ((SELECT count(*) FROM sets WHERE sets.i = doc.row_id) + 1) / n::DOUBLE"),
    ("usefulness", "1 - ((SELECT count(*) FROM sets WHERE sets.j = doc.row_id) + 1) / n::DOUBLE"),
    ("harmfulness", "(SELECT count(*) FROM enemies WHERE enemy = doc.row_id) / ((SELECT sum(n) FROM counts) - n)::DOUBLE"),
    ("lsr", "1 - least(1, (SELECT e / far FROM enemies WHERE enemies.i = doc.row_id))"),
):
    query(f"hardness_{_kind}", f"WITH {EMB2}, {SETS} SELECT row_id, label, round({_sql}, 6) AS complexity FROM doc JOIN counts USING (label)")(hard(_kind, _emb2))
query(
    "hardness_f1",
    f"WITH {DOC}, cells AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM doc), r AS (SELECT label, pos, min(v) AS low, max(v) AS high FROM cells GROUP BY label, pos), o AS (SELECT pos, max(low) AS low, min(high) AS high FROM r GROUP BY pos) SELECT row_id, label, round(avg((v >= low AND v <= high)::INT), 6) AS complexity FROM cells JOIN o USING (pos) GROUP BY row_id, label",
)(hard("f1"))
query("hardness_overlap_degenerate", f"WITH {DOC} SELECT row_id, label, round(1e0 / count(*) OVER (), 6) AS complexity FROM doc")(
    lambda spark, sf: rounded(hardness.overlap(doc_table(spark, sf).withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))), "complexity")
)


@query("knn_topk", f"WITH {EMB}, {knn_sql(5)} SELECT query_id, CAST(rk AS INT) AS rank, row_id, round(d * d, 6) AS d2, label FROM near")
def knn_topk(spark, sf):
    rows = embedding_table(spark, sf)
    return rounded(neighbours.nearest(rows, rows, 5), "d2")


@query("knn_within_class", f"WITH {EMB}, n AS (SELECT a.row_id AS query_id, b.row_id, list_distance(a.features, b.features) AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY list_distance(a.features, b.features), a.row_id <> b.row_id, b.row_id) AS rk FROM doc a JOIN doc b ON a.label = b.label QUALIFY rk <= 3) SELECT query_id, CAST(rk AS INT) AS rank, row_id, round(d * d, 6) AS d2 FROM n")
def knn_within_class(spark, sf):
    rows = embedding_table(spark, sf)
    return rounded(neighbours.nearest(rows, rows, 3, by=["label"], exclude_self=False), "d2").select("query_id", "rank", "row_id", "d2")


FOLDS = 3


def fold_sql(folds: int, shuffle: bool = False, b: str = "") -> str:
    """``folded``: doc with its fold, by b."""
    bj = f"{b}label"
    over = f"PARTITION BY {b.rstrip(', ')} " if b else ""
    return (
        f"fc AS (SELECT {bj}, count(*) AS n, min(row_id) AS f FROM doc GROUP BY {bj}), offs AS (SELECT {bj}, n, coalesce(sum(n) OVER ({over}ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM fc)"
        f", places AS (SELECT {bj}, fold, count(*) AS c FROM (SELECT {bj}, unnest(range(o::BIGINT, (o + n)::BIGINT)) % {folds} AS fold FROM offs) GROUP BY {bj}, fold)"
        f", ends AS (SELECT {bj}, fold, sum(c) OVER (PARTITION BY {bj} ORDER BY fold) AS e FROM places)"
        f", numbered AS (SELECT *, row_number() OVER (PARTITION BY {bj} ORDER BY {u_sql('fold', 'row_id') + ', ' if shuffle else ''}row_id) AS rk FROM doc)"
        f", folded AS (SELECT {b}row_id, m.label, features, min(fold) AS fold FROM numbered m JOIN ends USING ({bj}) WHERE rk <= e GROUP BY {b}row_id, m.label, features)"
    )


FOLD_SQL = f"{COUNTS}, {fold_sql(FOLDS)}"


def error_rate_sql(folds: int) -> str:
    """``hard`` by trees on the other folds."""
    held = f"tr AS (SELECT held::INT AS held, row_id, label, features, (fold <> held)::INT AS w FROM folded, range({folds}) x(held))"
    return f"{fold_sql(folds)}, {held}, {tree_sql('er', 'tr', 'held, ')}, hard AS (SELECT f.row_id, f.label, 1 - coalesce(p, 0) AS complexity FROM folded f LEFT JOIN er ON er.row_id = f.row_id AND er.class = f.label)"


@query("hardness_error_rate_tree", f"WITH RECURSIVE {DOC}, {error_rate_sql(FOLDS)} {HARD} hard")
def hardness_error_rate_tree(spark, sf):
    return rounded(hardness.error_rate(doc_table(spark, sf), Tree(), FOLDS), "complexity")


@query("stratified_folds", f"WITH {DOC}, {FOLD_SQL} SELECT row_id, label, CAST(fold AS INT) AS fold FROM folded")
def stratified_folds(spark, sf):
    return evaluation.stratified_folds(doc_table(spark, sf), FOLDS)


@query(
    "hardness_error_rate_nc",
    f"WITH {DOC}, {FOLD_SQL}, cells AS (SELECT row_id, label, fold, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM folded), fs AS (SELECT DISTINCT fold AS held FROM folded)"
    ", tc AS (SELECT held, label AS class, pos, avg(v) AS g FROM cells JOIN fs ON fold <> held GROUP BY held, label, pos)"
    ", sc AS (SELECT row_id, label, class, 1 / (1 + sqrt(sum((v - g) * (v - g)))) AS s FROM cells JOIN tc ON cells.pos = tc.pos AND held = fold GROUP BY row_id, label, class)"
    ", pr AS (SELECT row_id, label, class, s / sum(s) OVER (PARTITION BY row_id) AS p FROM sc) SELECT row_id, label, round(1 - p, 6) AS complexity FROM pr WHERE class = label",
)
def hardness_error_rate_nc(spark, sf):
    return rounded(hardness.error_rate(doc_table(spark, sf), NearestCentroid(), FOLDS), "complexity")


# ---- hardness by trees, likelihoods, features and a spanning tree ----
TREE = f"tr AS (SELECT row_id, label, features, 1 AS w FROM doc UNION ALL SELECT row_id, label, features, 0 FROM doc), {tree_sql('tree', 'tr')}"
LEAVES = "d AS (SELECT row_id, label, node, floor(log2(node))::INT AS depth FROM tree_last)"
#: Costs from the deepest nodes upwards, nodes that become leaves, and each row's first leaf from the root.
PRUNED = (
    f"nd AS (SELECT node, floor(log2(node))::INT AS depth, sum(n) - sum(n * n)::DOUBLE / sum(n) AS impurity, sum(n) AS n FROM tree_counts GROUP BY node)"
    f", pr AS (SELECT nd.*, n.n * {hardness.ALPHA!r}::DOUBLE AS price, EXISTS (SELECT 1 FROM nd c WHERE c.node = 2 * nd.node) AS inner_ FROM nd, (SELECT n FROM nd WHERE node = 1) n)"
    ", up AS (SELECT (SELECT max(depth) FROM nd) + 1 AS level, NULL::BIGINT AS node, NULL::BOOLEAN AS leaf, NULL::DOUBLE AS cost UNION ALL SELECT * FROM (WITH ch AS (SELECT node // 2 AS node, sum(cost) AS children FROM up WHERE node IS NOT NULL GROUP BY node // 2)"
    " SELECT depth, pr.node, NOT inner_ OR impurity + price <= children, CASE WHEN NOT inner_ OR impurity + price <= children THEN impurity + price ELSE children END FROM pr LEFT JOIN ch USING (node) WHERE depth = (SELECT any_value(level) - 1 FROM up)))"
    ", cutat AS (SELECT row_id, label, min(up.node) AS node FROM tree_last l JOIN up ON up.leaf AND l.node >> (floor(log2(l.node))::INT - floor(log2(up.node))::INT) = up.node AND up.node <= l.node GROUP BY row_id, label)"
)
for _kind, _sql in (
    ("tree_depth_unpruned", f"{TREE}, {LEAVES} SELECT row_id, label, round(depth / (SELECT max(floor(log2(node))) FROM tree_counts)::DOUBLE, 6) AS complexity FROM d"),
    ("disjunct_size", f"{TREE}, z AS (SELECT node, sum(n) AS n FROM tree_counts GROUP BY node), lf AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM z c WHERE c.node = 2 * z.node)) SELECT row_id, label, round(1 - (n - 1) / ((SELECT max(n) FROM lf) - 1)::DOUBLE, 6) AS complexity FROM tree_last JOIN lf USING (node)"),
    ("tree_depth_pruned", f"{TREE}, {PRUNED} SELECT row_id, label, round(coalesce(floor(log2(node)) / nullif((SELECT max(floor(log2(node))) FROM cutat), 0)::DOUBLE, 0), 6) AS complexity FROM cutat"),
    ("disjunct_class_percentage", f"{TREE}, {PRUNED} SELECT c.row_id, c.label, round(1 - n / (SELECT sum(n) FROM tree_counts t WHERE t.node = c.node)::DOUBLE, 6) AS complexity FROM cutat c JOIN tree_counts t ON t.node = c.node AND t.class = c.label"),
):
    query(f"hardness_{_kind}", f"WITH RECURSIVE {DOC}, {_sql}")(hard(_kind))

BAYES = (
    "bc AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM doc), bs AS (SELECT label AS class, pos, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM bc GROUP BY label, pos)"
    ", bv AS (SELECT max(v) * 1e-9 AS e FROM (SELECT var_pop(v) AS v FROM bc GROUP BY pos))"
    ", ll AS (SELECT row_id, bc.label, class, sum(CASE WHEN s + e > 0 THEN -0.5e0 * (ln(2 * pi() * (s + e)) + (v - m) * (v - m) / (s + e)) WHEN v = m THEN 0 ELSE '-infinity'::DOUBLE END) + ln(any_value(n) / (SELECT count(*) FROM doc)::DOUBLE) AS s FROM bc JOIN bs USING (pos), bv GROUP BY row_id, bc.label, class)"
    ", lm AS (SELECT *, max(s) OVER (PARTITION BY row_id) AS top FROM ll), nb AS (SELECT row_id, label, class, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY row_id) AS p FROM lm)"
)
query("hardness_class_likelihood", f"WITH {DOC}, {BAYES} SELECT row_id, label, round(1 - p, 6) AS complexity FROM nb WHERE class = label")(hard("class_likelihood"))
query("hardness_likelihood_difference", f"WITH {DOC}, {BAYES} SELECT row_id, label, round((1 - max(p) FILTER (class = label) + coalesce(max(p) FILTER (class <> label), 0)) / 2, 6) AS complexity FROM nb GROUP BY row_id, label")(hard("likelihood_difference"))


def efficiency_sql(width: int) -> str:
    """Rounds of f4, one for each feature: r{i} are the rows left, u{i} the features used."""
    parts_of, ends = ["r0 AS (SELECT row_id, label, features FROM doc), u0 AS (SELECT -1 AS pos)"], []
    for i in range(width):
        parts_of.append(
            f"c{i} AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM r{i})"
            f", g{i} AS (SELECT pos, max(low) AS low, min(high) AS high, count(*) AS k FROM (SELECT label, pos, min(v) AS low, max(v) AS high FROM c{i} GROUP BY label, pos) WHERE pos NOT IN (SELECT pos FROM u{i}) GROUP BY pos)"
            f", b{i} AS (SELECT pos, sum((k < 2 OR v < low OR v > high)::INT) AS n FROM c{i} JOIN g{i} USING (pos) GROUP BY pos HAVING n > 0 ORDER BY n DESC, pos LIMIT 1)"
            f", o{i} AS (SELECT row_id, label FROM c{i} JOIN b{i} USING (pos) JOIN g{i} USING (pos) WHERE k < 2 OR v < low OR v > high)"
            f", r{i + 1} AS (SELECT * FROM r{i} WHERE row_id NOT IN (SELECT row_id FROM o{i})), u{i + 1} AS (SELECT pos FROM u{i} UNION ALL SELECT pos FROM b{i})"
        )
        ends.append(f"SELECT row_id, label, {i} / {width}e0 AS c FROM o{i}")
    return f"{', '.join(parts_of)}, f4 AS ({' UNION ALL '.join(ends)} UNION ALL SELECT row_id, label, 1e0 FROM r{width})"


query("hardness_f4", f"WITH {DOC}, {efficiency_sql(3)} SELECT row_id, label, round(c, 6) AS complexity FROM f4")(hard("f4"))


@query("overlap_volume", f"WITH {LI}, c AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM doc), g AS (SELECT pos, max(low) AS low, min(high) AS high, max(high) - min(low) AS span FROM (SELECT label, pos, min(v) AS low, max(v) AS high FROM c GROUP BY label, pos) GROUP BY pos), s AS (SELECT pos, avg((v >= low AND v <= high)::INT) AS s FROM c JOIN g USING (pos) GROUP BY pos) SELECT round((SELECT product(CASE WHEN span > 0 THEN greatest(0, high - low) / span ELSE 1 END) FROM g), 6) AS f2, round((SELECT min(s) FROM s), 6) AS f3")
def overlap_volume(spark, sf):
    return rounded(hardness.overlap_volume(lineitems(spark, sf)), "f2", "f3")


#: Boruvka: each step finds the shortest edge out of each component; pointers are followed nine times, which is enough for 512.
_JUMPS = ", ".join(f"j{i + 1} AS (SELECT x.c, y.p FROM j{i} x JOIN j{i} y ON y.c = x.p)" for i in range(9))
SPANNING = (
    "pairs AS (SELECT a.row_id AS i, b.row_id AS j, list_distance(a.features, b.features) AS d FROM doc a JOIN doc b ON a.row_id <> b.row_id)"
    ", bo AS (SELECT row_id, row_id AS comp, NULL::BIGINT AS a, NULL::BIGINT AS b, 0 AS step FROM doc UNION ALL SELECT * FROM ("
    "WITH o AS (SELECT x.comp AS c, d, least(i, j) AS a, greatest(i, j) AS b, y.comp AS t FROM pairs JOIN bo x ON x.row_id = i JOIN bo y ON y.row_id = j WHERE x.comp <> y.comp)"
    ", e AS (SELECT c, a, b, t FROM o QUALIFY row_number() OVER (PARTITION BY c ORDER BY d, a, b) = 1)"
    f", j0 AS (SELECT e.c, CASE WHEN f.t = e.c AND e.c < e.t THEN e.c ELSE e.t END AS p FROM e JOIN e f ON f.c = e.t), {_JUMPS}"
    " SELECT bo.row_id, j9.p, e.a, e.b, bo.step + 1 FROM bo JOIN e ON e.c = bo.comp JOIN j9 ON j9.c = bo.comp))"
    ", mst AS (SELECT DISTINCT a, b FROM bo WHERE a IS NOT NULL), both_ AS (SELECT a AS i, b AS j FROM mst UNION ALL SELECT b, a FROM mst)"
)
query("hardness_n1", f"WITH RECURSIVE {DOC}, {SPANNING} SELECT x.row_id, x.label, round(avg((x.label <> y.label)::INT), 6) AS complexity FROM both_ JOIN doc x ON x.row_id = i JOIN doc y ON y.row_id = j GROUP BY x.row_id, x.label")(hard("n1"))


@query("ensemble_soft_bayes", f"{bags_sql()}, tb AS (SELECT member_id, label AS class, pos, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM (SELECT member_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM bag) GROUP BY member_id, label, pos), tv AS (SELECT member_id, max(v) * 1e-9 AS e FROM (SELECT member_id, pos, var_pop(v) AS v FROM (SELECT member_id, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM bag) GROUP BY member_id, pos) GROUP BY member_id), tn AS (SELECT member_id, count(*) AS t FROM bag GROUP BY member_id), rc AS (SELECT row_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM doc), ll AS (SELECT member_id, row_id, rc.label, class, sum(-0.5e0 * (ln(2 * pi() * (s + e)) + (v - m) * (v - m) / (s + e))) + ln(any_value(n) / any_value(t)::DOUBLE) AS s FROM rc JOIN tb USING (pos) JOIN tv USING (member_id) JOIN tn USING (member_id) GROUP BY member_id, row_id, rc.label, class), lm AS (SELECT *, max(s) OVER (PARTITION BY member_id, row_id) AS top FROM ll), proba AS (SELECT member_id, row_id, label, class, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY member_id, row_id) AS p FROM lm), {soft_sql('q', 'proba', str(MEMBERS))} SELECT row_id, label, class, round(p, 6) AS p FROM q")
def ensemble_soft_bayes(spark, sf):
    docs, model = fitted(spark, sf, NaiveBayes())
    return rounded(model.predict_proba(docs), "p").select("row_id", "label", "class", "p")


@query("hardness_statistics", f"WITH {DOC}, {OVERLAP} SELECT label, round(avg(complexity), 6) AS mean, round(stddev_pop(complexity), 6) AS std, round(min(complexity), 6) AS min, round(max(complexity), 6) AS max, round(quantile_cont(complexity, 0.5), 6) AS median FROM hard GROUP BY ROLLUP (label)")
def hardness_statistics(spark, sf):
    return rounded(evaluation.hardness_statistics(hardness.overlap(doc_table(spark, sf))), "mean", "std", "min", "max", "median")


# ---- weights and resampling ----
@query("gaussian_weights", f"WITH {DOC}, {OVERLAP}, w AS (SELECT row_id, label, greatest(exp(-0.5e0 * pow((complexity - 0.5e0) / 0.2e0, 2)) / (0.2e0 * sqrt(2 * pi())), 1e-10) AS weight FROM hard) SELECT row_id, label, round(weight, 6) AS weight, round(weight / sum(weight) OVER (PARTITION BY label), 6) AS p FROM w")
def gaussian_weights(spark, sf):
    return rounded(sampling.with_weights(hardness.overlap(doc_table(spark, sf)), 0.5, 0.2).select("row_id", "label", "weight", "p"), "weight", "p")


@query("gaussian_weights_floor", f"WITH {DOC}, {OVERLAP} SELECT row_id, label, round(ln(greatest(exp(-0.5e0 * pow((complexity - 1) / 0.1e0, 2)) / (0.1e0 * sqrt(2 * pi())), 1e-10)), 6) AS log_weight FROM hard")
def gaussian_weights_floor(spark, sf):
    return sampling.with_weights(hardness.overlap(doc_table(spark, sf)), 1.0, 0.1).select("row_id", "label", F.round(F.log("weight"), 6).alias("log_weight"))


@query("undersample_weighted", f"WITH {DOC}, {OVERLAP}, {resample_sql('0.5e0')} SELECT label, row_id FROM real")
def undersample_weighted(spark, sf):
    docs = cut(doc_table(spark, sf))
    weighted = sampling.with_weights(cut(hardness.with_complexity(docs)), 0.5, 0.2)
    return sampling.undersample(weighted, sampling.class_info(docs), SEED).select("label", "row_id")


@query("seed_lookup", f"WITH {DOC}, {OVERLAP}, {resample_sql('0.5e0')} SELECT label, slot, seed_row_id FROM drawn")
def seed_lookup(spark, sf):
    docs = cut(doc_table(spark, sf))
    weighted = sampling.with_weights(cut(hardness.with_complexity(docs)), 0.5, 0.2)
    short = sampling.class_info(docs).where("n < target")
    slots = sampling.slots_of(short.withColumn("missing", F.col("target") - F.col("n")), "label")
    return sampling.seeds(weighted, slots, SEED)


@query("oversample_synthetic", f"WITH {DOC}, {OVERLAP}, {resample_sql('0.5e0')} SELECT label, slot, seed_row_id, neighbor_row_id, round(alpha, 6) AS alpha, {columns_sql(3, 'made')} FROM made")
def oversample_synthetic(spark, sf):
    docs = cut(doc_table(spark, sf))
    weighted = sampling.with_weights(cut(hardness.with_complexity(docs)), 0.5, 0.2)
    return rounded(flat(sampling.oversample(weighted, sampling.class_info(docs), 3, SEED)), "alpha")


for _name, _mu in (("easy", 0.0), ("mid", 0.5), ("hard", 1.0)):

    @query(f"resample_{_name}", f"WITH {DOC}, {OVERLAP}, {resample_sql(f'{_mu}e0')} {balanced_sql()}")
    def resample(spark, sf, mu=_mu):
        return flat(sampling.resample(doc_table(spark, sf), mu, seed=SEED))


@query("resample_multiclass", f"WITH {EMB}, {OVERLAP}, {resample_sql('0.5e0')} {balanced_sql('', 4)}")
def resample_multiclass(spark, sf):
    return flat(sampling.resample(embedding_table(spark, sf), 0.5, seed=SEED), 4)


@query("shuffle_rank", f"WITH {DOC} SELECT row_id, round({u_sql('ord', 'row_id')}, 9) AS ord FROM doc")
def shuffle_rank(spark, sf):
    return sampling.shuffled(doc_table(spark, sf), SEED).select("row_id", F.round("ord", 9).alias("ord"))


# ---- ensemble ----
#: Members of the grid queries: one for each ten labelled rows.
GRID = f"WITH {DOC}, m AS (SELECT greatest(count(*) // 10, 2)::BIGINT AS m FROM doc), grid AS (SELECT i::INT AS member_id, i / (m - 1)::DOUBLE AS mu FROM m, range(m.m) r(i))"


def grid(spark, sf):
    return ensemble.mu_grid(spark, max(2, doc_table(spark, sf).count() // 10))


@query("mu_grid", f"{GRID} SELECT member_id, round(mu, 6) AS mu FROM grid")
def mu_grid(spark, sf):
    return rounded(grid(spark, sf), "mu")


@query("mu_distribution", f"{GRID} SELECT round(avg(mu), 6) AS mean, round(stddev_pop(mu), 6) AS std, min(mu) AS min, max(mu) AS max, count(*) AS n_members FROM grid")
def mu_distribution(spark, sf):
    return rounded(ensemble.mu_distribution(grid(spark, sf)), "mean", "std")


def fitted(spark, sf, learner=None, **options):
    docs = cut(doc_table(spark, sf))
    return docs, ensemble.Ensemble(members=MEMBERS, seed=SEED, learner=learner or NearestCentroid(), **options).fit(docs)


@query("ensemble_bags", f"{bags_sql()} {balanced_sql('member_id, ')}")
def ensemble_bags(spark, sf):
    return flat(ensemble.bags(doc_table(spark, sf), MEMBERS, seed=SEED))


@query("bag_class_counts", f"{bags_sql()} SELECT member_id, label, count(*) AS n FROM bag GROUP BY member_id, label")
def bag_class_counts(spark, sf):
    return ensemble.bags(doc_table(spark, sf), MEMBERS, seed=SEED).groupBy("member_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("ensemble_diversity", f"{bags_sql()}, r AS (SELECT DISTINCT member_id, list_transform(features, lambda x: round(x, 6)) AS f FROM bag), z AS (SELECT member_id, count(*) AS n FROM r GROUP BY member_id), c AS (SELECT a.member_id AS i, b.member_id AS j, count(*) AS c FROM r a JOIN r b ON a.f = b.f AND a.member_id < b.member_id GROUP BY i, j) SELECT round(avg(1 - coalesce(c, 0) / (x.n + y.n - coalesce(c, 0) + 1e-10)), 6) AS diversity FROM z x JOIN z y ON x.member_id < y.member_id LEFT JOIN c ON i = x.member_id AND j = y.member_id")
def ensemble_diversity(spark, sf):
    made = cut(ensemble.bags(doc_table(spark, sf), MEMBERS, seed=SEED)).withColumn("features", F.transform("features", lambda x: F.round(x, 6)))
    return rounded(ensemble.diversity(made), "diversity")


PROBA = f"{bags_sql()}, {nc_sql('bag', 'doc', 'member_id, ')}"
SOFT = f"{PROBA}, {soft_sql('q', 'proba', str(MEMBERS))}"
SOFT_PRED = f"{SOFT}, pred AS (SELECT row_id, label, class AS pred, p FROM q QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) = 1)"


@query("ensemble_proba_nc", f"{SOFT} SELECT row_id, label, class, round(p, 6) AS p FROM q")
def ensemble_proba_nc(spark, sf):
    docs, model = fitted(spark, sf)
    return rounded(model.predict_proba(docs), "p").select("row_id", "label", "class", "p")


@query("ensemble_soft_nc", f"{SOFT_PRED} SELECT row_id, label, pred FROM pred")
def ensemble_soft_nc(spark, sf):
    docs, model = fitted(spark, sf)
    return model.predict(docs)


@query("ensemble_hard_nc", f"{PROBA}, v AS (SELECT member_id, row_id, label, class FROM proba QUALIFY row_number() OVER (PARTITION BY member_id, row_id ORDER BY p DESC, class) = 1), t AS (SELECT row_id, label, class, count(*) AS n FROM v GROUP BY row_id, label, class) SELECT row_id, label, class AS pred FROM t QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, class) = 1")
def ensemble_hard_nc(spark, sf):
    docs, model = fitted(spark, sf, voting="hard")
    return model.predict(docs)


#: Trees grown on the bags, and the rows of doc for every member.
TREES = f"tr AS (SELECT member_id, NULL::BIGINT AS row_id, label, features, 1 AS w FROM bag UNION ALL SELECT member_id, row_id, label, features, 0 FROM doc, grid), {tree_sql('proba', 'tr', 'member_id, ')}"


@query("ensemble_soft_tree", f"{bags_sql().replace('WITH', 'WITH RECURSIVE', 1)}, {TREES}, {soft_sql('q', 'proba', str(MEMBERS))}, {pred_sql('pred', 'q')} SELECT row_id, label, pred FROM pred")
def ensemble_soft_tree(spark, sf):
    docs, model = fitted(spark, sf, Tree())
    return model.predict(docs)


@query("ensemble_hard_tree", f"{bags_sql().replace('WITH', 'WITH RECURSIVE', 1)}, {TREES}, {pred_sql('v', 'proba', 'member_id, ')}, t AS (SELECT row_id, label, pred AS class, count(*) AS p FROM v GROUP BY row_id, label, pred), {pred_sql('pred', 't')} SELECT row_id, label, pred FROM pred")
def ensemble_hard_tree(spark, sf):
    docs, model = fitted(spark, sf, Tree(), voting="hard")
    return model.predict(docs)


# ---- evaluation ----
@query("stratified_split", f"WITH {DOC}, {COUNTS} SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY {u_sql('split', 'row_id')}, row_id) <= floor(n * 0.3e0 + 0.5e0) AS is_test FROM doc JOIN counts USING (label)")
def stratified_split(spark, sf):
    return evaluation.stratified_split(doc_table(spark, sf), 0.3, SEED)


NC = f"WITH {DOC}, {nc_sql('doc', 'doc')}, pred AS (SELECT row_id, label, class AS pred FROM proba QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY p DESC, class) = 1)"


def nc_predictions(spark, sf):
    docs = doc_table(spark, sf)
    return ensemble.best_class(NearestCentroid().fit(docs).probabilities(docs))


CELL = "SELECT count(*) FILTER (label <> 1 AND pred <> 1) AS tn, count(*) FILTER (label <> 1 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred <> 1) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp FROM pred"
EACH = "each AS (SELECT c AS label, CASE WHEN sum(p) > 0 THEN sum(h) / sum(p)::DOUBLE ELSE 0e0 END AS precision, CASE WHEN sum(t) > 0 THEN sum(h) / sum(t)::DOUBLE ELSE 0e0 END AS recall, CASE WHEN sum(t) + sum(p) > 0 THEN 2 * sum(h) / (sum(t) + sum(p))::DOUBLE ELSE 0e0 END AS f1, CAST(sum(t) AS BIGINT) AS support FROM (SELECT label AS c, 1 AS t, 0 AS p, (label = pred)::INT AS h FROM pred UNION ALL SELECT pred, 0, 1, 0 FROM pred) GROUP BY c)"


@query("confusion_matrix", f"{NC} SELECT label, pred, count(*) AS n FROM pred GROUP BY label, pred")
def confusion_matrix(spark, sf):
    return evaluation.confusion(nc_predictions(spark, sf))


@query("binary_metrics", f"{NC}, c AS ({CELL}) SELECT tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp)::DOUBLE, 6) AS accuracy, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0e0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0e0 END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0e0 END, 6) AS f1 FROM c")
def binary_metrics(spark, sf):
    return rounded(evaluation.binary_metrics(nc_predictions(spark, sf)), "accuracy", "recall", "precision", "f1")


@query("weighted_f1", f"{NC}, {EACH} SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM each")
def weighted_f1(spark, sf):
    return rounded(evaluation.weighted_f1(nc_predictions(spark, sf)), "weighted_f1")


@query("classification_report", f"{NC}, {EACH}, a AS (SELECT avg((label = pred)::INT) AS h, count(*) AS n FROM pred), r AS (SELECT label::VARCHAR AS label, precision, recall, f1, support FROM each UNION ALL SELECT 'accuracy', h, h, h, n FROM a UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM each UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM each) SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r")
def classification_report(spark, sf):
    return rounded(evaluation.report(nc_predictions(spark, sf)), "precision", "recall", "f1")


@query("roc_auc", f"WITH {DOC}, {OVERLAP}, g AS (SELECT complexity AS s, sum(label) AS p, sum(1 - label) AS n FROM hard GROUP BY complexity), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM g) SELECT round(sum(p * (under + n / 2e0)) / (sum(p) * sum(n)), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return rounded(evaluation.roc_auc(hardness.overlap(doc_table(spark, sf)).withColumnRenamed("complexity", "score")), "auc")


def sweep(spark, sf):
    """mu and binary F1 of the nearest-centroid learner fitted on each member's bag, scored on all rows."""
    docs, model = fitted(spark, sf)
    pred = ensemble.best_class(model.probabilities(docs), "p", "member_id")
    yes, said = F.col("label") == 1, F.col("pred") == 1
    f1 = 2 * F.sum((yes & said).cast("int")) / (F.sum(yes.cast("int")) + F.sum(said.cast("int")))
    return pred.groupBy("member_id").agg(F.coalesce(f1, F.lit(0.0)).alias("f1")).join(F.broadcast(ensemble.mu_grid(spark, MEMBERS)), "member_id")


SWEEP = f"{PROBA}, v AS (SELECT member_id, row_id, label, class AS pred FROM proba QUALIFY row_number() OVER (PARTITION BY member_id, row_id ORDER BY p DESC, class) = 1), s AS (SELECT member_id, member_id / {MEMBERS - 1}e0 AS mu, 2 * sum((label = 1 AND pred = 1)::INT) / nullif(sum((label = 1)::INT) + sum((pred = 1)::INT), 0)::DOUBLE AS f1 FROM v GROUP BY member_id)"


@query("mu_sweep", f"{SWEEP} SELECT member_id, round(coalesce(f1, 0), 6) AS f1, mu FROM s")
def mu_sweep(spark, sf):
    return rounded(sweep(spark, sf), "f1")


@query("best_mu", f"{SWEEP} SELECT round(coalesce(f1, 0), 6) AS f1, mu FROM s ORDER BY 1 DESC, mu LIMIT 1")
def best_mu(spark, sf):
    return rounded(sweep(spark, sf), "f1").orderBy(F.desc("f1"), "mu").limit(1).select("f1", "mu")


def parts(spark, sf):
    """Training rows and the rows left out."""
    docs = cut(doc_table(spark, sf))
    split = cut(docs.join(evaluation.stratified_split(docs, 0.3, SEED), ["row_id", "label"]))
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")


#: ``doc`` are the rows to train on, ``test`` those left out.
PARTS = (
    DOC.replace("doc AS", "alldoc AS", 1) + f", split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {u_sql('split', 'row_id')}, row_id) <= floor(count(*) OVER (PARTITION BY label) * 0.3e0 + 0.5e0) AS is_test FROM alldoc)"
    ", doc AS (SELECT row_id, label, features FROM split WHERE NOT is_test), test AS (SELECT row_id, label, features FROM split WHERE is_test)"
)


def scores_sql(by: str = "") -> str:
    """``m``: the metrics of ``proba``, by ``by`` ("" or "member_id, ")."""
    return (
        f"pred AS (SELECT {by}row_id, label, class AS pred FROM proba QUALIFY row_number() OVER (PARTITION BY {by}row_id ORDER BY p DESC, class) = 1)"
        f", ps AS (SELECT {by}row_id, label, p AS score FROM proba WHERE class = 1)"
        f", au AS (SELECT {'a.' + by if by else ''}sum(CASE WHEN a.score > b.score THEN 1e0 WHEN a.score = b.score THEN 0.5e0 ELSE 0e0 END) / count(*) AS auc FROM ps a JOIN ps b ON {'a.member_id = b.member_id AND ' if by else ''}a.label = 1 AND b.label <> 1 {'GROUP BY a.member_id' if by else ''})"
        f", ce AS (SELECT {by}avg((label = pred)::INT) AS accuracy, coalesce(count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (pred = 1), 0)::DOUBLE, 0) AS precision, coalesce(count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 0) AS recall, coalesce(2 * count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (pred = 1), 0)::DOUBLE, 0) AS f1 FROM pred {'GROUP BY member_id' if by else ''})"
        f", m AS (SELECT ce.*, auc FROM ce {'JOIN au USING (member_id)' if by else ', au'})"
    )


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in comparison.METRICS)
EVALUATED = f"WITH {PARTS}, {nc_sql('doc', 'test')}, {scores_sql()}"


@query("evaluate_split_nc", f"{EVALUATED} SELECT {ROUNDED} FROM m")
def evaluate_split_nc(spark, sf):
    return rounded(comparison.evaluate(*parts(spark, sf), NearestCentroid()), *comparison.METRICS)


def dense(proba: str, classes: str = "doc", rows: str = "test", b: str = "") -> str:
    """``proba`` with a row for every class; b: "" or "member_id, " with a table ``grid`` of its values."""
    on = "row_id, label, class" if not b else f"{b}row_id, label, class"
    return f"proba AS (SELECT {b}x.row_id, x.label, class, coalesce(p, 0) AS p FROM {rows} x{' CROSS JOIN grid' if b else ''} CROSS JOIN (SELECT DISTINCT label AS class FROM {classes}) LEFT JOIN {proba} USING ({on}))"


FOREST_IN = "fin AS (SELECT row_id, NULL::BIGINT AS slot, label, features, 1 AS w FROM doc UNION ALL SELECT row_id, NULL, label, features, 0 FROM test)"


@query("evaluate_split_forest", f"WITH RECURSIVE {PARTS}, {FOREST_IN}, {forest_sql('forest', 'fin', 100)}, {dense('forest')}, {scores_sql()} SELECT {ROUNDED} FROM m")
def evaluate_split_forest(spark, sf):
    return rounded(comparison.evaluate(*parts(spark, sf), Forest(100)), *comparison.METRICS)


STRATEGIES = (
    f"WITH {PARTS}, {OVERLAP}, {resample_sql('mu', k=5, members=3)}, bag AS (SELECT member_id, label, features FROM real UNION ALL SELECT member_id, label, list_transform(range(1, len(fa) + 1), lambda i: fa[i] + alpha * (fb[i] - fa[i])) FROM made UNION ALL SELECT -1, label, features FROM doc)"
    f", {nc_sql('bag', 'test', 'member_id, ')}, {scores_sql('member_id, ')}, named AS (SELECT member_id + 1 AS position, CASE member_id WHEN -1 THEN 'baseline' WHEN 0 THEN 'easy_instances' WHEN 1 THEN 'uniform' ELSE 'hard_instances' END AS name, m.* FROM m)"
)


def strategies(spark, sf):
    return rounded(comparison.compare_strategies(*parts(spark, sf), NearestCentroid(), seed=SEED), *comparison.METRICS)


@query("compare_strategies", f"{STRATEGIES} SELECT CAST(position AS INT) AS position, name, {ROUNDED} FROM named")
def compare_strategies(spark, sf):
    return strategies(spark, sf)


@query("best_by_metric", f"{STRATEGIES}, r AS (SELECT position, name, {ROUNDED} FROM named), l AS (UNPIVOT (SELECT position, name, f1, auc, recall FROM r) ON f1, auc, recall INTO NAME metric VALUE value) SELECT metric, name, value FROM l QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, position) = 1")
def best_by_metric(spark, sf):
    return evaluation.winners(strategies(spark, sf))


#: hard by each measure; kNN ties go to the smaller id.
MEASURES = {
    "overlap": OVERLAP,
    "neighborhood": f"{knn_sql(5)}, hard AS (SELECT query_id AS row_id, own AS label, avg((own <> label)::INT) AS complexity FROM near GROUP BY query_id, own)",
    "error_rate": error_rate_sql(5),
}


def measured_bags(measure: str, tail: str, source: str = "traindoc", **options) -> str:
    """A query on its own: rows of ``source`` resampled by a measure, then ``tail``."""
    return f"(WITH RECURSIVE doc AS (SELECT row_id, label, features FROM {source}), {MEASURES[measure]}, {resample_sql(**options)} {tail})"


#: The id of a synthetic row.
MADE_ID = "-1 - ('0x' || substr(md5(label || ':' || slot), 1, 15))::BIGINT"


def id_tail(b: str = "") -> str:
    return f"SELECT {b}row_id, label, features FROM real UNION ALL SELECT {b}{MADE_ID}, label, list_transform(range(1, len(fa) + 1), lambda i: fa[i] + alpha * (fb[i] - fa[i])) FROM made"


COMPARED = " UNION ALL ".join(f"SELECT {i} AS member_id, NULL::BIGINT AS slot, 1 AS w, * FROM {measured_bags(m, id_tail(), mu='0.5e0', k=5)}" for i, m in enumerate(MEASURES))
HARDNESS_COMPARED = (
    f"WITH RECURSIVE {PARTS}, traindoc AS (FROM doc), grid AS (SELECT i::INT AS member_id FROM range({len(MEASURES)}) r(i)), fin AS (SELECT member_id, row_id, slot, label, features, w FROM ({COMPARED}) UNION ALL SELECT member_id, row_id, NULL, label, features, 0 FROM test, grid)"
    f", {forest_sql('forest', 'fin', 20, 'member_id, ')}, {dense('forest', b='member_id, ')}, {scores_sql('member_id, ')}"
)


@query("compare_hardness", f"{HARDNESS_COMPARED} SELECT member_id AS position, CASE member_id {' '.join(f'WHEN {i} THEN {chr(39)}{m}{chr(39)}' for i, m in enumerate(MEASURES))} END AS name, {ROUNDED} FROM m")
def compare_hardness(spark, sf):
    """Metrics of a forest on rows left out, resampled by each hardness measure."""
    return rounded(comparison.compare_measures(*parts(spark, sf), Forest(20), seed=SEED), *comparison.METRICS)


STEPS, SWEPT_TREES = 5, 50
SWEPT = (
    f"WITH RECURSIVE {PARTS}, traindoc AS (FROM doc), swept AS {measured_bags('overlap', id_tail('member_id, '), mu='mu', k=5, members=STEPS)}"
    f", fin AS (WITH doc AS (FROM swept), {fold_sql(3, b='member_id, ')} SELECT member_id, held::INT AS held, row_id, NULL::BIGINT AS slot, label, features, (fold <> held)::INT AS w FROM folded, range(3) x(held))"
    f", {forest_sql('forest', 'fin', SWEPT_TREES, 'member_id, held, ')}, {pred_sql('pred', 'forest', 'member_id, held, ')}"
    f", f AS (SELECT member_id, held, coalesce(2 * count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (pred = 1), 0)::DOUBLE, 0) AS f1 FROM pred GROUP BY member_id, held)"
)


@query("mu_sweep_cross_validated", f"{SWEPT} SELECT member_id AS position, round(member_id / {STEPS - 1}e0, 6) AS mu, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std FROM f GROUP BY member_id")
def mu_sweep_cross_validated(spark, sf):
    return rounded(comparison.sweep_mu(parts(spark, sf)[0], Forest(SWEPT_TREES), steps=STEPS, folds=3, seed=SEED), "mu", "mean", "std")


SIZES = (3, 5, 10, 15, 20)
SIZE_GRID = " UNION ALL ".join(f"SELECT {n} AS members, i::INT AS member_id, i / {n - 1}e0 AS mu FROM range({n}) r(i)" for n in SIZES)
SIZE_SWEEP = (
    f"WITH {PARTS}, {OVERLAP}, {resample_sql('mu', k=5, grid=SIZE_GRID, b='members, member_id, ')}, {bag_sql('members, member_id, ')}, {nc_sql('bag', 'test', 'members, member_id, ')}"
    f", {soft_sql('q', 'proba', 'members', 'members, ')}, {pred_sql('pred', 'q', 'members, ')}"
)


@query("members_sweep", f"{SIZE_SWEEP} SELECT members, round(coalesce(2 * count(*) FILTER (label = 1 AND pred = 1) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (pred = 1), 0)::DOUBLE, 0), 6) AS f1, round((SELECT stddev_pop(mu) FROM grid WHERE grid.members = pred.members), 6) AS mu_std FROM pred GROUP BY members")
def members_sweep(spark, sf):
    """F1 on rows left out by the number of members, and the spread of mu."""
    return rounded(ensemble.members_sweep(*parts(spark, sf), SIZES, NearestCentroid(), seed=SEED), "f1", "mu_std")


def f1_sql(pred: str, b: str) -> str:
    """``wf``: weighted F1 by b."""
    return (
        f"cells AS (SELECT {b}c, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM (SELECT {b}label AS c, 1 AS t, 0 AS p, (label = pred)::INT AS h FROM {pred} UNION ALL SELECT {b}pred, 0, 1, 0 FROM {pred}) GROUP BY {b}c)"
        f", wf AS (SELECT {b.rstrip(', ')}, sum(CASE WHEN t + p > 0 THEN 2 * h / (t + p)::DOUBLE ELSE 0 END * t) / sum(t) AS f1 FROM cells GROUP BY {b.rstrip(', ')})"
    )


SUMMARY = "SELECT name, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(min(f1), 6) AS min, round(max(f1), 6) AS max FROM wf GROUP BY name"


def fold_bags(hardness_of: dict, sigma: dict, folds: int, members: int) -> str:
    """Bags of each setting on all folds but one."""
    parts_of = (
        f"SELECT '{name}' AS name, {held} AS held, * FROM {measured_bags(m, f', {bag_sql()} SELECT member_id, label, features FROM bag', f'(SELECT * FROM folded WHERE fold <> {held})', mu='mu', sigma=sigma[name], k=5, members=members)}"
        for name, m in hardness_of.items()
        for held in range(folds)
    )
    return " UNION ALL ".join(parts_of)


_CONFIGURED = {c["name"]: c["hardness"] for c in ensemble.CONFIGURATIONS}, {c["name"]: c["sigma"] for c in ensemble.CONFIGURATIONS}
CONFIGURED = (
    f"WITH RECURSIVE {DOC}, {fold_sql(3, True)}, bags AS ({fold_bags(*_CONFIGURED, 3, MEMBERS)})"
    ", tc AS (SELECT name, held, member_id, label AS class, pos, avg(v) AS g FROM (SELECT name, held, member_id, label, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM bags) GROUP BY name, held, member_id, label, pos)"
    ", rc AS (SELECT row_id, label, fold AS held, unnest(features) AS v, generate_subscripts(features, 1) AS pos FROM folded)"
    ", sc AS (SELECT name, held, member_id, row_id, label, class, 1 / (1 + sqrt(sum((v - g) * (v - g)))) AS s FROM rc JOIN tc USING (held, pos) GROUP BY name, held, member_id, row_id, label, class)"
    ", proba AS (SELECT name, held, member_id, row_id, label, class, s / sum(s) OVER (PARTITION BY name, held, member_id, row_id) AS p FROM sc)"
    f", {soft_sql('q', 'proba', str(MEMBERS), 'name, held, ')}, {pred_sql('pred', 'q', 'name, held, ')}, {f1_sql('pred', 'name, held, ')}"
)


@query("compare_configurations", f"{CONFIGURED} {SUMMARY}")
def compare_configurations(spark, sf):
    return rounded(ensemble.compare_configurations(doc_table(spark, sf), MEMBERS, learner=NearestCentroid()), "mean", "std", "min", "max")


LEARNED = (
    f"WITH RECURSIVE {DOC}, {fold_sql(5)}, fin AS (SELECT held::INT AS held, row_id, NULL::BIGINT AS slot, label, features, (fold <> held)::INT AS w FROM folded, range(5) x(held))"
    f", {tree_sql('tree', 'fin', 'held, ')}, {forest_sql('forest', 'fin', 10, 'held, ')}, {forest_sql('bagging', 'fin', 10, 'held, ', None)}"
    f", bags AS ({fold_bags({'ensemble': 'overlap'}, {'ensemble': 0.2}, 5, MEMBERS)}), tr AS (SELECT held, member_id, NULL::BIGINT AS row_id, label, features, 1 AS w FROM bags UNION ALL SELECT fold::INT, m::INT, row_id, label, features, 0 FROM folded, range({MEMBERS}) r(m))"
    f", {tree_sql('members', 'tr', 'held, member_id, ')}, {soft_sql('ensemble', 'members', str(MEMBERS), 'held, ')}"
    f", every AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS name, held, row_id, label, class, p FROM {n}' for n in ('tree', 'forest', 'bagging', 'ensemble'))})"
    f", {pred_sql('pred', 'every', 'name, held, ')}, {f1_sql('pred', 'name, held, ')}"
)


@query("compare_learners", f"{LEARNED} {SUMMARY}")
def compare_learners(spark, sf):
    """Weighted F1 over folds of tree, forest, bagging and the ensemble of trees."""
    learners = {"tree": Tree(), "forest": Forest(10), "bagging": Forest(10, every=True)}
    return rounded(ensemble.compare_learners(doc_table(spark, sf), learners, MEMBERS), "mean", "std", "min", "max")


@query("generated_imbalance", f"WITH g AS (SELECT CASE WHEN {u_sql('flip', 'row_id')} < 0.05e0 THEN floor({u_sql('to', 'row_id')} * 2)::INT WHEN {u_sql('class', 'row_id')} < 0.95e0 THEN 0 ELSE 1 END AS label FROM range((SELECT count(*) FROM documents)) r(row_id)) SELECT label, count(*) AS n FROM g GROUP BY label")
def generated_imbalance(spark, sf):
    """Classes of a generated table with as many rows as there are documents."""
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    return evaluation.class_counts(imbalanced(spark, n, weights=(0.95, 0.05)))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
