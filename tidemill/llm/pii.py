"""Personal data: candidate spans, gradient-boosted trees, calibrated thresholds.

Base rules find e-mail addresses, IPv4 addresses, payment cards and international phone
numbers. Wider generators propose further spans that overlap freely: obfuscated addresses,
IPv6, cards with other separators, phones without a plus, and secrets (access tokens, keys),
for which there is no base rule. Boosted trees judge a proposal by its format and by the
characters around it. They learn from what the base rules accept
and reject in the corpus: spans that pass are positives, spans of the same look that fail,
such as plain numbers, are negatives. They also learn from the wide proposals: one on a base
span of its kind is a positive; of the others those after a cue word are positives, the rest
negatives. All candidates count: those that look the same are one row with their number. Per kind, the threshold is the lowest
score at which the wide proposals of a held-out part that are on no base span of their kind are
precise enough; a kind that never gets there adds nothing. Cue words decide labels only, so a
proposal without one is added if it looks like those with one. Base spans always stay.

Everything is DataFrame expressions and Spark ML on them; positions are code points, end
exclusive, and come from the lengths of the pieces around the matches.

Defined results: a null text is an empty one and has no spans. Matches of one pattern do not
overlap and go from left to right. Repeated rows have equal results. Added spans of one kind
never overlap base spans of that kind; they come from one pattern, so not each other. Without
both positives and negatives nothing is learned and nothing is added. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialize

KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]  # secrets are only ever learned
# A run that a pattern begins with is entered only at its first character, or where the last
# match ended: other entries cannot give a leftmost match, and trying them is quadratic.
# Repeated groups are possessive where nothing follows: Java recurses for the others.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63})++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){2,3}(?:[./_][0-9]{1,3})?(?![0-9])",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
    # an unbroken run with a digit; the run is entered only at its first character
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]{0,511}[0-9])[A-Za-z0-9_+/-]{16,512}+(?![A-Za-z0-9_+/-])",
}
CONTEXT = 24
GROUP = ["kind", "wide", "clear", "label"]
STEPS = 1 << 14  # steps of a score that thresholds are found in
CUES = {
    "email": "mail|contact|kontakt|@",
    "ip": "ip|host|server|addr|login",
    "card": "card|visa|karte|carte|tarjeta|pay",
    "phone": "tel|phone|call|fax|mobil|ruf",
    "secret": "(?:token|secret|passw|api.?key|access.?key|credential|bearer)[a-z_]*[ =:\"']*$",
}


@dataclass(frozen=True)
class PiiSettings:
    total_weight: int = 20_000  # of all candidates that trees are fitted on
    trees: int = 12
    depth: int = 4
    bins: int = 512  # up to its square, and so far beyond what was seen, split points come from all looks
    precision: float = 0.98
    least_calibrated: int = 20  # proposals that a threshold must rest on


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right as (start, stop, value, before, after)."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    # zipped, so that the text is gone through once for each of the three and not per match
    zipped = F.arrays_zip(found.alias("value"), pieces.alias("before"), F.slice(pieces, F.lit(2), F.lit(1 << 30)).alias("after"))
    around = F.filter(zipped, lambda x: x["value"].isNotNull())
    kind = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["value"])
        one = F.struct(
            start.alias("start"), stop.alias("stop"), x["value"].alias("value"),
            F.right(x["before"], F.lit(CONTEXT)).alias("before"), F.left(x["after"], F.lit(CONTEXT)).alias("after"),
        )
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(around, begin, step, lambda acc: acc["out"])


def _luhn(numbers: Column) -> Column:
    return F.call_function("luhn_check", numbers)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(short) <= 3) & (F.left(short, F.lit(3)).cast("int") <= 255)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & _luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_and_candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, the row's number, a digest that sets a part aside, base (kind, start, stop) and candidates with their look and context."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # read only once written
    none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string,after:string>>")
    for kind in KINDS:
        needed = F.col("text").contains(NEEDS[kind]) & F.col("text").rlike("[0-9]" if kind != "email" else "@")
        rows = rows.withColumn(f"m_{kind}", F.when(needed, matches(F.col("text"), BASE[kind])).otherwise(none))

    for kind in ALL_KINDS:
        rows = rows.withColumn(f"w_{kind}", F.when(F.col("text").rlike("[0-9@\\[(]"), matches(F.col("text"), WIDE[kind])).otherwise(none))

    def spans(kind: str) -> Column:
        passed = F.filter(f"m_{kind}", lambda x: valid(kind, x["value"]))
        return F.transform(passed, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["stop"].alias("stop")))

    def proposals(kind: str, wide: bool) -> Column:
        def one(x: Column) -> Column:
            ok = F.lit(None).cast("int") if wide else valid(kind, x["value"]).cast("int")
            return F.struct(
                F.lit(ALL_KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"),
                x["before"].alias("before"), x["after"].alias("after"), ok.alias("label"),
            )

        return F.transform(f"{'w' if wide else 'm'}_{kind}", one)

    base = F.sort_array(F.concat(*map(spans, KINDS)))
    return rows.select(
        "doc_id", "row", F.xxhash64("doc_id", "text").alias("draw"), base.alias("base"),
        F.concat(*(proposals(k, False) for k in KINDS), *(proposals(k, True) for k in ALL_KINDS)).alias("candidates"),
    )


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context of candidates as numbers; what decides a label (length, check digit, cue words) is not among them."""
    value, before, after = F.col("value"), F.lower("before"), F.lower("after")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    numbers = digits(value)
    columns = {f"is_{k}": (F.col("kind") == i).cast("double") for i, k in enumerate(ALL_KINDS)}
    columns |= {
        "n_chars": F.length(value).cast("double"),
        "n_letters": count("[A-Za-z]"),
        "n_not_hex": count("[G-Zg-z]"),
        "n_turns": count("[0-9][A-Za-z]"),
        "n_blanks": count(" "),
        "n_dots": count("\\."),
        "n_dashes": count("-"),
        "n_colons": count(":"),
        "n_brackets": count("[()\\[\\]]"),
        "has_plus": value.startswith("+").cast("double"),
        "n_kinds": F.size(F.array_distinct(F.split(numbers, ""))).cast("double"),
        "longest_run": F.coalesce(F.array_max(F.transform(F.split(value, "[^0-9]+"), F.length)), F.lit(0)).cast("double"),
        "after_word": before.rlike(r"[a-z0-9]$").cast("double"),
        "before_word": after.rlike(r"^[a-z0-9]").cast("double"),
        "after_sign": before.rlike(r"[.#$:/=_-]$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "digits_near": F.regexp_count(F.concat(before, after), F.lit("[0-9]")).cast("double"),
    }
    for name, column in columns.items():
        rows = rows.withColumn(f"f_{name}", column)
    return rows, [f"f_{name}" for name in columns]


def labelled(candidates: DataFrame) -> DataFrame:
    """Adds `wide`, `clear` (of base spans of the kind) and a label for wide proposals."""
    own = F.exists("base", lambda b: (b["kind"] == F.col("kind")) & (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))
    cue = F.coalesce(*(F.when(F.col("kind") == i, F.lower("before").rlike(CUES[k])) for i, k in enumerate(ALL_KINDS)))
    weak = F.when(own, 1).otherwise(cue.cast("int"))
    return candidates.withColumns({"wide": F.col("label").isNull(), "clear": ~own, "label": F.coalesce("label", weak)})


def looks_of(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    """All labelled candidates, those that look the same and have the same part and label as one row with their number."""
    rows, names = features(candidates)
    aside = F.pmod(F.xxhash64("start", "draw"), F.lit(4)) == 0
    group = [*GROUP, "aside", *names]
    looks = rows.withColumn("aside", aside).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return looks.sortWithinPartitions(*group), names  # one order on every run


def weighted(looks: DataFrame, most: int) -> DataFrame:
    """Adds `weight`: groups share `most` evenly, so that a frequent one does not outweigh the others; at most 40 of them."""
    sizes = {tuple(r[c] for c in GROUP): r["n"] for r in looks.groupBy(*GROUP).agg(F.sum("n").alias("n")).collect()}
    left, each = most, F.lit(0.0)
    for place, (values, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        share = min(size, left / (len(sizes) - place))
        left -= share
        mine = F.lit(True)
        for c, value in zip(GROUP, values):
            mine &= F.col(c) == value
        each = F.when(mine, F.lit(share / size)).otherwise(each)
    return looks.withColumn("weight", each * F.col("n"))


def fit(candidates: DataFrame, settings: PiiSettings):
    """(model, thresholds by kind) from all labelled candidates, or None."""
    s = settings
    looks, names = looks_of(candidates)
    looks = materialize(looks, "pii-looks")
    train = weighted(looks.filter(~F.col("aside")), s.total_weight)
    kinds = {r["label"] for r in train.select("label").distinct().collect()}
    if kinds != {0, 1}:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="vector")
    trees = GBTClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", maxIter=s.trees, maxDepth=s.depth, maxBins=s.bins, seed=1, stepSize=0.3
    )
    model = trees.fit(assembler.transform(train))
    return model, thresholds_of(_scored(looks.filter(F.col("aside") & F.col("wide") & F.col("clear")), model, names), s)


def thresholds_of(scored: DataFrame, settings: PiiSettings) -> dict[int, float]:
    """Per kind the lowest score, in steps of 1 / STEPS, from which up enough proposals are right; all rows (kind, label, score, n) count."""
    s, step = settings, F.floor(F.col("score") * STEPS)
    counted = scored.groupBy("kind", step.alias("step")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"))
    thresholds, seen = {}, {}
    for r in sorted(counted.collect(), key=lambda r: -r["step"]):  # one row for each kind and step
        n, right = (a + b for a, b in zip(seen.get(r["kind"], (0, 0)), (r["n"], r["right"])))
        seen[r["kind"]] = n, right
        if n >= s.least_calibrated and right >= s.precision * n:
            thresholds[r["kind"]] = r["step"] / STEPS
    return thresholds


def _scored(rows: DataFrame, model, names: list[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=names, outputCol="vector").transform(rows)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1])


def find(docs: DataFrame, key: str, text: str, settings: PiiSettings | None = None) -> DataFrame:
    """doc_id, base and added arrays of (start, kind, stop) for every row of `docs`."""
    s = settings or PiiSettings()
    table = materialize(base_and_candidates(docs, key, text), "pii-candidates")
    spans = "array<struct<start:int,kind:int,stop:int>>"
    each = table.filter(F.size("candidates") > 0).select("row", "draw", "base", F.explode("candidates").alias("x"))
    each = labelled(each.select("row", "draw", "base", "x.*"))
    fitted = fit(each, s)
    if fitted is None or not fitted[1]:
        return table.select("doc_id", "base", F.array().cast(spans).alias("added"))
    model, thresholds = fitted
    fresh, names = features(each.filter(F.col("wide") & F.col("clear")))
    least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()), F.lit(2.0))
    chosen = _scored(fresh, model, names).filter(F.col("score") >= least)
    added = chosen.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "stop"))).alias("added"))
    joined = table.join(added, "row", "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast(spans)).alias("added"))


def redact(text: Column, spans: Column) -> Column:
    """The text with its spans (start, kind, stop) replaced by kind marks; overlaps become one."""
    names = F.array(*(F.lit(f"[{k}]") for k in ALL_KINDS))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(gap, F.element_at(names, x["kind"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    done = F.aggregate(spans, begin, step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined, of an array in order."""
    names = F.array(*map(F.lit, ALL_KINDS))
    each = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")))
    return F.concat_ws(",", each)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {k})")).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    everything = F.sort_array(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(everything).alias("spans")
    )
