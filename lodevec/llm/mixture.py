"""Mixing sources to target shares of the total tokens: entropy balancing with a cap on repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import settle

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The driver holds one number per planned source; a plan with more sources is refused.
MAX_SOURCES = 100_000
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def with_tokens(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, source, tokens): the whole text's tokens; 0 for a NULL text. ``source`` comes out trimmed and in lower case."""
    kind = dict(docs.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["key", "source", "tokens"])

    rows = docs.select(F.col(key).alias("key"), F.lower(F.trim(F.col(source))).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {kind}, source string, tokens bigint")


def plan_of(targets: DataFrame) -> DataFrame:
    """(planned, weight, cap): weights of equal names add up, the larger cap holds; NULL, NaN or negative weights count 0, a
    NULL or negative cap 0."""
    weight = F.col("target_weight").cast("double")
    weight = F.when(weight.isNull() | F.isnan(weight) | (weight < 0), 0.0).otherwise(weight)
    return (
        targets.select(F.lower(F.trim("source")).alias("planned"), weight.alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
        .where("planned is not null").groupBy("planned").agg(F.sum("weight").alias("weight"), F.max("cap").alias("cap"))
    )


def balance(counted: DataFrame, targets: DataFrame, size: str = "input", rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(planned, share, cap, tokens, wanted, short, tilt, mean): one row per planned source.

    The rates of greatest entropy whose token sums meet the targets are w = min(cap, exp(tilt * tokens / mean)), with one
    tilt per source, the dual variable of its constraint. The dual is convex and separable, so that Newton steps for all
    sources run at once: each is one aggregate over (source, tokens, how many documents), which holds all that the sums
    need and is written once; a bisection bracket keeps each step inside. The first evaluation is at the far end of the
    bracket: where even there the sum stays below the target, the dual has no optimum, the source is ``short`` and all its
    documents are taken ``cap`` times. A source that does not settle in ``rounds`` steps raises.

    ``size``: what the targets are shares of. "input": the tokens of all documents of planned sources, by which ``short`` is
    defined in either case. "shares": the largest mix in which every source that isn't short has its share of the mix
    itself. The short sources then give all they may, and as they fall short of their share of the input, the mix is as
    much smaller as they are together. If they give nothing, the shares are those among the other sources.
    """
    if size not in ("input", "shares"):
        raise ValueError("size must be input or shares")
    spark = counted.sparkSession
    plan = plan_of(targets)
    if plan.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} planned sources")
    hist = settle(
        counted.join(plan, F.col("source") == F.col("planned")).groupBy("planned", "cap", "tokens").agg(F.count("*").alias("n")), "hist"
    )
    mass = F.col("tokens") * F.col("n")
    far = hist.groupBy(F.col("planned").alias("s")).agg(F.sum(mass).alias("tokens"), F.sum("n").alias("docs"), F.sum(mass * F.col("cap")).alias("most"))
    rows = plan.join(far, F.col("planned") == F.col("s"), "left").drop("s").collect()
    weights, total = math.fsum(r.weight for r in rows), sum(r.tokens or 0 for r in rows)
    state = {}
    for r in rows:
        share = r.weight / weights if weights else 0.0
        wanted, most = share * total, r.most or 0
        short = most < wanted
        state[r.planned] = {"share": share, "cap": r.cap, "tokens": r.tokens or 0, "most": most, "wanted": wanted, "short": short, "mean": r.tokens / r.docs if r.tokens else 1.0}
    if size == "shares":
        _resize(state)
    for v in state.values():
        # all documents at the cap, or none: the ends of the range need no search
        v["open"] = 0 < v["wanted"] < v["most"]
        v["tilt"] = 0.0 if v["open"] else (math.inf if v["wanted"] > 0 else -math.inf)
        v["lo"], v["hi"] = -math.inf, math.inf
    for _ in range(rounds):
        tilts = [(s, v["tilt"], v["mean"]) for s, v in state.items() if v["open"]]
        if not tilts:
            break
        at = spark.createDataFrame(tilts, "p string, tilt double, mean double")
        x = F.col("tokens") / F.col("mean")
        free = F.exp(F.col("tilt") * x)
        weight = mass.cast("double")
        sums = (
            hist.join(at, F.col("planned") == F.col("p")).groupBy("p")
            .agg(F.sum(weight * F.least(free, F.col("cap"))).alias("sum"), F.sum(F.when(free < F.col("cap"), weight * x * free).otherwise(0.0)).alias("slope"))
            .collect()
        )
        for r in sums:
            v = state[r.p]
            gap = r["sum"] - v["wanted"]
            if abs(gap) <= tolerance * v["wanted"] or v["hi"] - v["lo"] <= 1e-13 * (1 + abs(v["tilt"])):
                v["open"] = False
                continue
            v["lo"], v["hi"] = (v["tilt"], v["hi"]) if gap < 0 else (v["lo"], v["tilt"])
            step = v["tilt"] - gap / r.slope if r.slope else math.nan
            if not v["lo"] < step < v["hi"]:
                lo = v["lo"] if math.isfinite(v["lo"]) else min(-1.0, 2 * v["hi"] - 1)
                hi = v["hi"] if math.isfinite(v["hi"]) else max(1.0, 2 * v["lo"] + 1)
                step = (lo + hi) / 2
            v["tilt"] = step
    lost = [s for s, v in state.items() if v["open"]]
    if lost:
        raise RuntimeError(f"the mix did not settle for {len(lost)} sources, {lost[0]} for one")
    out = [(s, v["share"], v["cap"], v["tokens"], float(v["wanted"]), v["short"], v["tilt"], v["mean"]) for s, v in state.items()]
    return spark.createDataFrame(out, "planned string, share double, cap int, tokens bigint, wanted double, short boolean, tilt double, mean double")


def _resize(state: dict[str, dict]) -> None:
    """``wanted`` for shares of the mix itself; see ``balance``."""
    low = [v for v in state.values() if v["short"]]
    rest = [v for v in state.values() if not v["short"] and v["share"] > 0]
    given, missing = sum(v["most"] for v in low), math.fsum(v["share"] for v in low)
    if not low:
        return
    if given:
        whole, of = given / missing, 1.0
    else:
        of = math.fsum(v["share"] for v in rest)
        whole = min((v["most"] * of / v["share"] for v in rest), default=0.0)
        whole = min(whole, float(sum(v["tokens"] for v in state.values())))
    for v in low:
        v["wanted"] = float(v["most"])
    for v in rest:
        v["wanted"] = v["share"] / of * whole


#: Steps into which a level of the search for a source's rounding threshold divides the range before it.
STEPS = 1024


def mix(counted: DataFrame, solved: DataFrame, seed: int = 7, levels: int = 3) -> DataFrame:
    """(key, source, tokens, rate, copies) for the documents of planned sources that come out at least once.

    A rate is rounded up where a hash of the key, less the rate's fraction, lies below a threshold of the source; 0 would
    round each rate with its fraction as probability, and the threshold is moved from there until the source's tokens meet
    its target to less than a document, and one document of about the missing length follows. The search is ``levels``
    aggregates over (source, step); a document never comes out more often than the cap.
    """
    spark = counted.sparkSession
    s = solved.select("planned", "cap", "tilt", "mean")
    rate = F.when(F.col("tilt") == float("inf"), F.col("cap").cast("double")).when(F.col("tilt") == float("-inf"), 0.0)
    rate = rate.otherwise(F.least(F.col("cap").cast("double"), F.exp(F.col("tilt") * F.col("tokens") / F.col("mean"))))
    u = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    rows = counted.join(s, F.col("source") == F.col("planned")).withColumn("rate", rate)
    part = F.col("rate") - F.floor("rate")
    rows = settle(rows.select("key", "source", "tokens", "rate", F.floor("rate").alias("least"), F.when(part > 0, u - part).alias("flips")), "rates")
    firm = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("least")).alias("firm"))
    need = solved.join(firm, F.col("planned") == F.col("source")).select("planned", (F.col("wanted") - F.col("firm")).alias("need")).collect()
    state = {r.planned: [-1.0, 2.0, r.need] for r in need}  # where the threshold is sought, and the tokens still wanted
    loose = rows.where("flips is not null and tokens > 0")
    for _ in range(levels):
        at = spark.createDataFrame([(p, *x) for p, x in state.items() if x[1] > 0], "p string, low double, width double, need double")
        step = F.floor((F.col("flips") - F.col("low")) / F.col("width") * STEPS)
        inside = loose.join(F.broadcast(at), F.col("source") == F.col("p")).withColumn("step", step).where((F.col("step") >= 0) & (F.col("step") < STEPS))
        by_step = inside.groupBy("p", "need", "step").agg(F.sum("tokens").alias("t"))
        w = Window.partitionBy("p").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = by_step.withColumn("sum", F.sum("t").over(w))
        # the first step that goes beyond what is wanted, and what all steps before it give
        over = reached.where("sum > need").groupBy("p").agg(F.min(F.struct("step", (F.col("sum") - F.col("t")).alias("before"), "t")).alias("f")).select("p", "f.*")
        got = {r.p: r for r in over.collect()}
        for p, x in state.items():
            if x[1] == 0:
                continue
            if p in got:
                x[0], x[1], x[2] = x[0] + got[p].step * x[1] / STEPS, x[1] / STEPS, x[2] - got[p].before
            else:
                x[0], x[1] = x[0] + x[1], 0.0  # all that may be rounded up is
    at = spark.createDataFrame([(p, x[0], x[2]) for p, x in state.items()], "p string, bound double, left double")
    placed = rows.join(F.broadcast(at), F.col("source") == F.col("p"), "left")
    up = F.coalesce(F.col("flips") < F.col("bound"), F.lit(False))
    # less than the next document is missing now: the one whose length comes nearest to that is taken as well
    miss = F.abs(F.col("tokens") - F.col("left"))
    near = placed.where(F.col("flips").isNotNull() & ~up & (F.col("tokens") > 0)).groupBy(F.col("source").alias("of")).agg(F.min(F.struct(miss.alias("miss"), "key", "left")).alias("one"))
    near = near.where("one.miss < one.left").select("of", F.col("one.key").alias("also"))
    placed = placed.join(F.broadcast(near), F.col("source") == F.col("of"), "left")
    copies = F.col("least") + (up | F.coalesce((F.col("key") == F.col("also")) & F.col("flips").isNotNull(), F.lit(False))).cast("bigint")
    return placed.select("key", "source", "tokens", "rate", copies.cast("bigint").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, solved: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, mixed_tokens, short) for every planned source."""
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    out = solved.select("planned", "share", "short").join(got, F.col("planned") == F.col("source"), "left").crossJoin(F.broadcast(total))
    mixed_tokens = F.coalesce("mixed_tokens", F.lit(0))
    return out.select(
        F.col("planned").alias("source"), F.col("share").alias("target_share"),
        F.coalesce(mixed_tokens / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), mixed_tokens.alias("mixed_tokens"), "short",
    )
