"""The synthetic twin and how close it is to its source."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.inputs import duck_digest, duck_uniform, table
from catalog.joins import PRODUCT, document_product
from catalog.registry import query, sql_with
from tidemill.config import Layout
from tidemill.functions import masks, vectors
from tidemill.operators import clean, dependent, privacy, twin
from tidemill.plans.documents import stored
from tidemill.plans.twins import QUASI, TARGET, VALUES, twin_source
from tidemill.session import work_dir
from tidemill.sources import collections

SEED = 42
KEY = "reference"
SOURCE_SQL = (
    "source AS (SELECT reference, date, central_bank AS country, speaker AS author, title, "
    "monetary_stance, trade_stance, economic_outlook, tariff_mention, is_gov, summary FROM product)"
)
SOURCE = [*PRODUCT, SOURCE_SQL]
CATEGORICAL = ["date", "country", "author", "title", "summary"]


def source(spark, sf):
    return twin_source(document_product(spark, sf))


@query(
    "g1_roles",
    sql_with(
        SOURCE,
        " UNION ALL ".join(
            f"SELECT '{name}' AS \"column\", '{role}' AS role, {bounds}, count({name}) AS filled, "
            + ("NULL::DOUBLE AS least, NULL::DOUBLE AS most" if role == "categorical" else f"min({name}::INT)::DOUBLE AS least, max({name}::INT)::DOUBLE AS most")
            + " FROM source"
            for name, role, bounds in [
                *((n, "categorical", "NULL::DOUBLE AS low, NULL::DOUBLE AS high") for n in ("date", "country", "author", "title", "summary")),
                *((n, "numeric", "1.0::DOUBLE AS low, 5.0::DOUBLE AS high") for n in ("monetary_stance", "trade_stance", "economic_outlook")),
                *((n, "binary", "NULL::DOUBLE AS low, NULL::DOUBLE AS high") for n in ("tariff_mention", "is_gov")),
            ]
        ),
    ),
)
def g1_roles(spark, sf):
    rows = source(spark, sf)
    return twin.observed_roles(rows, twin.infer_roles(rows, KEY))


def _permuted(column: str) -> str:
    return (
        f"p_{column} AS (SELECT {column}, row_number() OVER (ORDER BY "
        f"{duck_digest('reference', SEED, column)}) - 1 AS position FROM source)"
    )


PERMUTED_SQL = [_permuted(c) for c in CATEGORICAL]
_JOIN = " ".join(f"JOIN p_{c} USING (position)" for c in CATEGORICAL[1:])


@query(
    "g2_permute",
    sql_with(
        [*SOURCE, *PERMUTED_SQL],
        f"SELECT position, {', '.join(CATEGORICAL)} FROM p_date {_JOIN}",
    ),
)
def g2_permute(spark, sf):
    return twin.permuted_columns(source(spark, sf), KEY, CATEGORICAL, SEED)


def _nudged(column: str) -> str:
    moved = f"{column} + CAST(floor({duck_uniform('reference', SEED, column)} * 3) AS INTEGER) - 1"
    return f"CAST(greatest(1, least(5, {moved})) AS INTEGER) AS {column}"


NUMERIC = ["monetary_stance", "trade_stance", "economic_outlook"]
_FLIP_TARIFF = (
    f"CASE WHEN {duck_uniform('reference', SEED, 'tariff_mention')} < 0.2 "
    "THEN 1 - tariff_mention ELSE tariff_mention END AS tariff_mention"
)
_FLIP_GOV = (
    f"CASE WHEN {duck_uniform('reference', SEED, 'is_gov')} < 0.2 THEN NOT is_gov "
    "ELSE is_gov END AS is_gov"
)


@query(
    "g3_perturb",
    sql_with(SOURCE, "SELECT reference, " + ", ".join(_nudged(c) for c in NUMERIC) + " FROM source"),
)
def g3_perturb(spark, sf):
    rows = source(spark, sf).select(KEY, *NUMERIC)
    return twin.perturb(rows, KEY, twin.infer_roles(rows, KEY), SEED)


@query("g4_flip", sql_with(SOURCE, f"SELECT reference, {_FLIP_TARIFF}, {_FLIP_GOV} FROM source"))
def g4_flip(spark, sf):
    rows = source(spark, sf).select(KEY, "tariff_mention", "is_gov")
    return twin.perturb(rows, KEY, twin.infer_roles(rows, KEY), SEED)


TWIN_SQL = [
    *SOURCE,
    *PERMUTED_SQL,
    "base AS (SELECT "
    + ", ".join(_nudged(c) for c in NUMERIC)
    + f", {_FLIP_TARIFF}, {_FLIP_GOV}, row_number() OVER (ORDER BY "
    f"{duck_digest('reference', SEED, 'row')}) - 1 AS position FROM source)",
    "twin AS (SELECT printf('SYNTH-%06d', position) AS reference, date, country, author, title, "
    "monetary_stance, trade_stance, economic_outlook, tariff_mention, is_gov, summary, "
    f"true AS is_synthetic FROM base JOIN p_date USING (position) {_JOIN})",
]


def stored_source(spark, sf):
    """The source written once: making and judging a twin read it several times."""
    return stored(source(spark, sf), f"{work_dir(spark, 'twin')}/source")


def made(spark, sf, rows=None):
    rows = stored_source(spark, sf) if rows is None else rows
    return twin.make_twin(rows, twin.infer_roles(rows, KEY), KEY, SEED)


@query("g5_twin", sql_with(TWIN_SQL, "SELECT * FROM twin"))
def g5_twin(spark, sf):
    return made(spark, sf)


LINKED = ["monetary_stance", "trade_stance", "economic_outlook", "tariff_mention", "is_gov", "country", "author"]
CODED_SQL = (
    "coded AS (SELECT "
    + ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '') AS {c}" for c in LINKED)
    + " FROM source)"
)


def _information(a: str, b: str) -> str:
    weight = "(SELECT sum(n * ln(n)) FROM (SELECT count(*)::DOUBLE AS n FROM coded GROUP BY {0}))"
    rows = "(SELECT count(*)::DOUBLE FROM coded)"
    shared = f"ln({rows}) - ({weight.format(a)} + {weight.format(b)} - {weight.format(f'{a}, {b}')}) / {rows}"
    return f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(greatest({shared}, 0), 6) AS information"


@query(
    "g5_pair_information",
    sql_with([*SOURCE, CODED_SQL], " UNION ALL ".join(_information(a, b) for a, b in combinations(LINKED, 2))),
)
def g5_pair_information(spark, sf):
    """How much every two columns of the twin's source tell about each other."""
    found = dependent.pair_information(source(spark, sf).select(*LINKED), LINKED)
    return found.withColumn("information", F.round("information", 6))


#: parents set by hand, so that SQL can draw along the same tree
TREE = [
    ("monetary_stance", None), ("trade_stance", "monetary_stance"), ("economic_outlook", "trade_stance"),
    ("tariff_mention", "monetary_stance"), ("is_gov", "tariff_mention"), ("country", "is_gov"), ("author", "country"),
]


def _tree_sql() -> list[str]:
    steps, rows = [], "SELECT unnest(range((SELECT count(*) FROM coded))) AS position"
    steps.append(f"step_0 AS ({rows})")
    for i, (child, parent) in enumerate(TREE):
        steps.append(
            f"counts_{child} AS (SELECT {parent or repr('')} AS p, {child} AS c, count(*) AS n FROM coded GROUP BY 1, 2), "
            f"ranges_{child} AS (SELECT p, c, n, sum(n) OVER (PARTITION BY p) AS total, sum(n) OVER "
            f"(PARTITION BY p ORDER BY md5(c) ROWS UNBOUNDED PRECEDING) AS past FROM counts_{child}), "
            f"step_{i + 1} AS (SELECT t.*, r.c AS {child} FROM step_{i} t JOIN ranges_{child} r ON r.p = "
            f"{'t.' + parent if parent else repr('')} AND floor({duck_uniform('t.position', SEED, child)} * r.total) < r.past "
            f"AND floor({duck_uniform('t.position', SEED, child)} * r.total) >= r.past - r.n)"
        )
    return steps


_KINDS = {**dict.fromkeys([*NUMERIC, "tariff_mention"], "INTEGER"), "is_gov": "BOOLEAN", "country": "VARCHAR", "author": "VARCHAR"}


_DRAWN = (
    "SELECT printf('SYNTH-%06d', position) AS reference, "
    + ", ".join(f"CAST(CASE WHEN {c} <> '' THEN substr({c}, 2) END AS {_KINDS[c]}) AS {c}" for c in LINKED)
    + f", true AS is_synthetic FROM step_{len(TREE)}"
)


@query("g5_drawn_tree", sql_with([*SOURCE, CODED_SQL, *_tree_sql()], _DRAWN))
def g5_drawn_tree(spark, sf):
    return dependent.dependent_twin(stored_source(spark, sf), LINKED, KEY, SEED, TREE)


def _pair_distance(a: str, b: str) -> str:
    shares = f"(SELECT {a} AS x, {b} AS y, count(*)::DOUBLE / (SELECT count(*) FROM {{0}}) AS share FROM {{0}} GROUP BY 1, 2)"
    gap = (
        "(SELECT round(sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2, 6) FROM {0} a FULL JOIN {1} b "
        "ON a.x IS NOT DISTINCT FROM b.x AND a.y IS NOT DISTINCT FROM b.y)"
    )
    real, shuffled, drawn = (shares.format(t) for t in ("source", "twin", "drawn"))
    return (
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {gap.format(real, shuffled)} AS shuffled, "
        f"{gap.format(real, drawn)} AS dependent"
    )


@query(
    "g5_pair_distances",
    sql_with(
        [*TWIN_SQL, CODED_SQL, *_tree_sql(), f"drawn AS ({_DRAWN})"],
        " UNION ALL ".join(_pair_distance(a, b) for a, b in combinations(LINKED, 2)),
    ),
)
def g5_pair_distances(spark, sf):
    """Pairs of columns: how far the shuffled and the drawn twin are from the source."""
    rows = stored_source(spark, sf)
    apart = dependent.pair_distances(rows, made(spark, sf, rows), LINKED)
    drawn = dependent.dependent_twin(rows, LINKED, KEY, SEED, TREE)
    linked = dependent.pair_distances(rows, drawn, LINKED)
    rounded = lambda df, name: df.select("column_a", "column_b", F.round("distance", 6).alias(name))
    return rounded(apart, "shuffled").join(rounded(linked, "dependent"), ["column_a", "column_b"])


@query("g6_select", sql_with(SOURCE, "SELECT * FROM source"))
def g6_select(spark, sf):
    return source(spark, sf)


_HELD = f"{duck_uniform('doc_id', SEED, 'holdout')} < 0.05"


@query(
    "g7_holdout",
    "SELECT doc_id, CASE WHEN "
    f"{_HELD} THEN 'holdout' ELSE 'training' END AS part FROM documents",
)
def g7_holdout(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    training, holdout = twin.holdout_split(rows, "doc_id", SEED)
    return training.withColumn("part", F.lit("training")).unionByName(
        holdout.withColumn("part", F.lit("holdout"))
    )


_ATTRIBUTES = ["country", "author", "monetary_stance", "trade_stance", "tariff_mention"]
LEAK_MATCH = " AND ".join(f"t.{c} IS NOT DISTINCT FROM s.{c}" for c in _ATTRIBUTES)
LEAK_SQL = (
    "leak AS (SELECT count(*) AS twin_rows, count(*) FILTER (WHERE EXISTS "
    f"(SELECT 1 FROM source s WHERE {LEAK_MATCH})) AS leaked_rows FROM twin t)"
)


@query(
    "g9_leak",
    sql_with(
        [*TWIN_SQL, LEAK_SQL],
        "SELECT twin_rows, leaked_rows, round(leaked_rows / twin_rows, 6) AS leak_rate FROM leak",
    ),
)
def g9_leak(spark, sf):
    rows = stored_source(spark, sf)
    found = privacy.leak_rate(rows, made(spark, sf, rows), _ATTRIBUTES)
    return found.withColumn("leak_rate", F.round("leak_rate", 6))


GUESS_SQL = (
    "votes AS (SELECT country, is_gov, monetary_stance, count(*) AS n FROM twin GROUP BY ALL), "
    "best AS (SELECT country, is_gov, monetary_stance AS guess FROM (SELECT *, row_number() OVER "
    "(PARTITION BY country, is_gov ORDER BY n DESC, monetary_stance) AS r FROM votes) WHERE r = 1), "
    "guesses AS (SELECT count(*) AS real_rows, count(*) FILTER (WHERE b.guess = s.monetary_stance) "
    "AS guessed_rows FROM source s LEFT JOIN best b ON s.country IS NOT DISTINCT FROM b.country "
    "AND s.is_gov IS NOT DISTINCT FROM b.is_gov)"
)


@query(
    "g9_inference",
    sql_with(
        [*TWIN_SQL, GUESS_SQL],
        "SELECT real_rows, guessed_rows, round(guessed_rows / real_rows, 6) AS inference_rate "
        "FROM guesses",
    ),
)
def g9_inference(spark, sf):
    rows = stored_source(spark, sf)
    found = privacy.inference_rate(rows, made(spark, sf, rows), QUASI, TARGET)
    return found.withColumn("inference_rate", F.round("inference_rate", 6))


def _distance(column: str) -> str:
    shares = (
        f"SELECT {column} AS v, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM {{0}}) AS share "
        f"FROM {{0}} GROUP BY 1"
    )
    return (
        f"SELECT '{column}' AS \"column\", round(sum(abs(coalesce(a.share, 0) - "
        f"coalesce(b.share, 0))) / 2, 6) AS distance FROM ({shares.format('source')}) a "
        f"FULL JOIN ({shares.format('twin')}) b ON a.v IS NOT DISTINCT FROM b.v"
    )


MARGINAL_SQL = "gaps AS (" + " UNION ALL ".join(_distance(c) for c in VALUES) + ")"


@query("g9_marginal", sql_with([*TWIN_SQL, MARGINAL_SQL], "SELECT * FROM gaps"))
def g9_marginal(spark, sf):
    rows = stored_source(spark, sf)
    found = privacy.marginal_distances(rows, made(spark, sf, rows), VALUES)
    return found.withColumn("distance", F.round("distance", 6))


CLOSEST = ["country", *NUMERIC, "tariff_mention", "is_gov"]
_APART = " + ".join(f"CAST(t.{c} IS DISTINCT FROM s.{c} AS INTEGER)" for c in CLOSEST)
_KEPT_OUT = f"{duck_uniform('reference', SEED, 'holdout')} < 0.05"


def _closeness(part: str) -> str:
    return (
        f"SELECT '{part}' AS part, distance, count(*) AS rows FROM (SELECT t.reference, min({_APART}) AS distance "
        f"FROM {part} t, source s GROUP BY t.reference) GROUP BY distance"
    )


@query(
    "g9_closest_record",
    sql_with(
        [
            *PRODUCT,
            SOURCE_SQL.replace("source AS", "everything AS", 1),
            f"source AS (SELECT * FROM everything WHERE NOT {_KEPT_OUT})",
            f"holdout AS (SELECT * FROM everything WHERE {_KEPT_OUT})",
            *TWIN_SQL[len(SOURCE) :],
        ],
        f"{_closeness('twin')} UNION ALL {_closeness('holdout')}",
    ),
)
def g9_closest_record(spark, sf):
    """The twin and the rows held out, both against the rows that the twin was made from."""
    training, holdout = twin.holdout_split(stored_source(spark, sf), KEY, SEED)
    sides = {"twin": made(spark, sf, training), "holdout": holdout}
    return privacy.closeness(sides, training, CLOSEST)


@query(
    "g8_report",
    sql_with(
        [*TWIN_SQL, LEAK_SQL, GUESS_SQL, MARGINAL_SQL],
        "SELECT (SELECT count(*) FROM twin) AS total_records, "
        "(SELECT count(*) FROM source) AS input_records, "
        "round(1 - leaked_rows / twin_rows, 5) AS mia_score, "
        "round(1 - guessed_rows / real_rows, 5) AS aia_score, "
        "round(1 - (SELECT avg(distance) FROM gaps), 5) AS quality_score, "
        "(2 - leaked_rows / twin_rows - guessed_rows / real_rows) / 2 > 0.7 AS privacy_passed, "
        f"'twin-check' AS job_id, '{inputs.RUN_TIME}' AS generated_at, "
        "'3.0' AS report_version, true AS includes_summary, "
        "false AS holdout_disabled FROM leak, guesses",
    ),
)
def g8_report(spark, sf):
    # several measures read both tables, so both are stored first
    rows = stored_source(spark, sf)
    synthetic = stored(made(spark, sf, rows), f"{work_dir(spark, 'twin')}/made")
    scored = privacy.scores(rows, synthetic, _ATTRIBUTES, QUASI, TARGET, VALUES)
    report = privacy.evaluation_report(rows, synthetic, scored, inputs.RUN_TIME, "twin-check")
    names = ["mia_score", "aia_score", "quality_score"]
    return report.withColumns({name: F.round(name, 5) for name in names}).drop(
        "synthesis_columns", "synthesis_type", "report_type"
    )


def _mask_sql() -> str:
    steps, previous = [], "documents"
    counts = []
    for kind, pattern in inputs.IDENTIFIERS.items():
        steps.append(
            f"after_{kind} AS (SELECT * REPLACE (regexp_replace(text, '{pattern}', "
            f"'[{kind.upper()}]', 'g') AS text), "
            f"CAST(len(regexp_extract_all(text, '{pattern}')) AS INTEGER) AS {kind}s "
            f"FROM {previous})"
        )
        counts.append(f"{kind}s")
        previous = f"after_{kind}"
    return sql_with(steps, f"SELECT doc_id, text, {', '.join(counts)} FROM {previous}")


@query("g10_mask", _mask_sql())
def g10_mask(spark, sf):
    return masks.mask_text(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "g11_isolation",
    sql_with(
        TWIN_SQL,
        "SELECT 'documents' AS collection, count(*) AS objects, CAST(0 AS BIGINT) AS synthetic "
        "FROM source UNION ALL SELECT 'synthetic', count(*), count(*) FILTER (WHERE is_synthetic "
        "AND starts_with(reference, 'SYNTH-')) FROM twin",
    ),
)
def g11_isolation(spark, sf):
    """Both tables indexed: each collection holds its own kind only."""
    layout = Layout(work_dir(spark, "isolation"))
    rows = stored_source(spark, sf)
    vector = vectors.hash_embedding("title", 16).alias("embedding")
    found = []
    for name, objects in [
        ("documents", clean.document_objects(rows.select("*", vector))),
        ("synthetic", clean.twin_objects(made(spark, sf, rows).select("*", vector))),
    ]:
        path = layout.collection(name)
        collections.load_collection(objects, path)
        marked = F.col("reference").startswith("SYNTH-")
        if name == "synthetic":
            marked = marked & F.col("is_synthetic")
        found.append(
            collections.read_collection(spark, path).agg(
                F.lit(name).alias("collection"),
                F.count(F.lit(1)).alias("objects"),
                F.count_if(marked).alias("synthetic"),
            )
        )
    return found[0].unionByName(found[1])
