"""Mixing sources to target weights by pivotal dependent rounding.

A row of a source should be taken target / source size times. The whole part is certain; the fractional part p is
rounded to 0 or 1 by pivots: two rows with fractional p exchange mass, sized by their words, until one of them becomes
integral, so that each row keeps its expectation and the source's words are kept exactly. Groups of about ``FAN`` rows
are folded this way, each leaving at most one fractional row; these residuals are folded again, in a reduction tree
that ends with at most one row for each source, so the words taken differ from the target by less than one row's. Folds
go from long rows to short ones, and ``STEPS`` rows of each size, by powers of two, are kept for the top of the tree: the
residual walks down these steps, so that the row left last is a short one of its source, unless one row is many times
as long as the next.

All work is in DataFrame functions. Draws are hashes of the row and its group, so reruns agree, also over other splits of
the input. A group is picked by hash of the row among as many as the source's row count asks for, so a hot source has
many groups and no task gets all of it; a group that rows of the same id and text crowd is dealt further by their number
among rows that are equal in all that is kept of them, so it doesn't matter which gets which number. The tree holds ids,
sizes and hashes, never texts.

Null texts have size 0; rows without words are taken 0 times. A null source is a source, last in order. Rows that
repeat are separate rows, as are rows without an id. An empty table gives an empty mix. Columns other than the key, text
and source play no part. The sources' own table is put in order in one task: it has a row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import checkpoint

#: Rows that are folded at once, about.
FAN = 64
#: Rows of each source and each power of two in size that are folded last.
STEPS = 64
#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source's target is at most so many times its size.
CAP = 3.0
#: A mass within this of 0 or 1 is integral.
EPS = 1e-9


def words(text: Column) -> Column:
    """Number of words, white space being that of ASCII."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds target to (source, source_size, n): all sizes shared by weight, none above ``cap`` times its own size.

    The sources that meet their cap are the first ones by cap / weight, so two running sums find them: a source is
    capped if its cap is no more than its share of what those before it leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    of = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", cap * F.col("source_size"))
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    of = of.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    of = of.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    w_left = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return of.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * left / w_left)).select("source", "source_size", "n", F.col("w").alias("weight"), "target")


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _fold(units: Column) -> Column:
    """Pivots an array of (at, p, size, u); struct of done, (at, up) for each row but the residual, and the residual (at, p, size).

    With a row of mass p and the residual of mass q, the row can rise by at most a = min(1 - p, q * t / s) and fall
    by at most b = min(p, (1 - q) * t / s), where s and t are their sizes; it rises with probability b / (a + b), and
    the residual gives or takes the same number of words.
    """
    none = F.lit(None).cast("struct<at:bigint,p:double,size:double>")
    begin = F.struct(F.array().cast("array<struct<at:bigint,up:int>>").alias("done"), none.alias("rest"))

    def unit(at: Column, p: Column, size: Column) -> Column:
        return F.struct(at.alias("at"), p.alias("p"), size.alias("size"))

    def state(done: Column, rest: Column) -> Column:
        return F.struct(done.alias("done"), rest.alias("rest"))

    def settled(x: Column) -> Column:
        return F.array(F.struct(x["at"].alias("at"), F.when(x["p"] > 0.5, 1).otherwise(0).alias("up")))

    def integral(x: Column) -> Column:
        return (x["p"] < EPS) | (x["p"] > 1 - EPS)

    def pivot(s: Column, x: Column) -> Column:
        rest = s["rest"]

        def moved(r: Column) -> Column:
            up = x["u"] * (r["a"] + r["b"]) < r["b"]
            step = F.when(up, r["a"]).otherwise(-r["b"])
            return F.struct(unit(x["at"], x["p"] + step, x["size"]).alias("one"), unit(rest["at"], rest["p"] - step * x["size"] / rest["size"], rest["size"]).alias("two"))

        def parted(m: Column) -> Column:
            one, two = m["one"], m["two"]
            both = integral(one) & integral(two)
            return state(
                F.concat(s["done"], F.when(both, F.concat(settled(one), settled(two))).when(integral(one), settled(one)).otherwise(settled(two))),
                F.when(both, none).when(integral(one), two).otherwise(one),
            )

        ratio = rest["size"] / x["size"]
        room = F.struct(F.least(1 - x["p"], rest["p"] * ratio).alias("a"), F.least(x["p"], (1 - rest["p"]) * ratio).alias("b"))
        return _let(_let(room, moved), parted)

    def step(s: Column, x: Column) -> Column:
        return F.when(integral(x), state(F.concat(s["done"], settled(x)), s["rest"])).when(s["rest"].isNull(), state(s["done"], unit(x["at"], x["p"], x["size"]))).otherwise(pivot(s, x))

    return F.aggregate(units, begin, step)


def _draw(*of: Column) -> Column:
    """A number in [0, 1) that depends on these columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds number: 0, 1, ... among the rows that are equal in ``key``, counted in each part of the input and then over the parts."""
    part = F.shiftright("place", 33)  # the part that a monotonically increasing id is from
    rows = rows.withColumn("part", part).withColumn("number", F.row_number().over(Window.partitionBy(*key, "part").orderBy("place")))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*key, "part").agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"counts.{c}")) for c in [*key, "part"]]
    joined = rows.alias("rows").join(counts.alias("counts"), same)
    return joined.select("rows.*", "before").withColumn("number", F.col("number") - 1 + F.col("before")).drop("part", "before")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 1, identity: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (copies times size) and copies of each row.

    ``identity``, if given, comes back with each row under that name; it should be small, such as a hash of the row.
    """
    own = [identity.alias("identity")] if identity is not None else []
    rows = checkpoint(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("salt"), F.monotonically_increasing_id().alias("place"), *own))
    own = ["identity"] * len(own)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    shares = checkpoint(targets(sizes, weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
    whole = F.floor(F.col("rate") + EPS)
    rows = rows.withColumn("whole", whole).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("rate") - whole, F.lit(0.0))).otherwise(0.0))
    blank, rows = rows.where("size = 0"), rows.where("size > 0")  # rows without words are taken 0 times, apart from the tree
    # steps of each size for the top of the tree: each is a group of its own, below 0, until then
    size_of = F.floor(F.log2("size")).cast("int")
    fair = F.xxhash64("salt", "size", F.lit(seed), F.lit("step"))
    of_size = Window.partitionBy("source", "octave").orderBy("fair", "doc_id", "salt", "size", *own, "place")
    steps = rows.select("source", "doc_id", "salt", "size", *own, "place", size_of.alias("octave"), fair.alias("fair"))
    steps = steps.withColumn("rung", F.row_number().over(of_size)).where(F.col("rung") <= STEPS)
    steps = steps.select(F.col("place").alias("step"), (-1 - F.col("octave") * STEPS - F.col("rung")).cast("long").alias("own_g"))
    rows = rows.join(steps, F.col("place") == F.col("step"), "left").drop("step")
    # the bottom of the tree: the other rows by hash into groups, in order of size
    groups = F.greatest(F.ceil(F.col("n") / FAN), F.lit(1))
    rows = checkpoint(rows.drop("of").withColumn("g", F.coalesce("own_g", F.pmod(F.xxhash64("salt", "size", F.lit(seed)), groups))).drop("own_g"))
    crowded = rows.groupBy(F.col("source").alias("of"), F.col("g").alias("to")).agg(F.count("*").alias("held")).where(F.col("held") > 4 * FAN)
    rows = rows.join(crowded, F.col("source").eqNullSafe(F.col("of")) & (F.col("g") == F.col("to")), "left").drop("of", "to")
    key = ["source", "doc_id", "salt", "size", *own]
    dealt = _numbered(rows.where("held IS NOT NULL"), key)
    piece = F.pmod(F.xxhash64("salt", "number", F.lit(seed)), F.ceil(F.col("held") / FAN))
    dealt = dealt.withColumn("g", F.col("g") + groups * piece).drop("number")
    rows = rows.where("held IS NULL").unionByName(dealt)
    unit = F.struct("size", "doc_id", "salt", *own, "whole", "p")
    below = rows.groupBy("source", "g").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"), *(F.first(c).alias(c) for c in ("source_size", "target", "n")))
    draw = lambda x, i: _draw(x["salt"], F.col("g"), i, F.lit(seed))
    inputs = F.transform("units", lambda x, i: F.struct(i.cast("long").alias("at"), x["p"].alias("p"), x["size"].cast("double").alias("size"), draw(x, i).alias("u")))
    below = checkpoint(below.withColumn("fold", _fold(inputs)))
    # the levels above: each folds the residuals of the groups below, as many levels as the largest source needs
    most = -(-(shares.agg(F.max("n")).first()[0] or 0) // FAN)
    levels = [below]
    while True:
        now = levels[-1].where("fold.rest IS NOT NULL").select("source", F.ceil(F.col("n") / FAN).alias("n"), F.col("g").alias("at"), "fold.rest.p", "fold.rest.size")
        salt = F.lit(seed + len(levels))
        most = -(-most // FAN)
        groups = F.greatest(F.ceil(F.col("n") / FAN), F.lit(1)) if most > 1 else F.lit(1)
        group = F.pmod(F.xxhash64("at", salt), groups)
        group = F.when(F.col("at") < 0, F.col("at")).otherwise(group) if most > 1 else group
        now = now.groupBy("source", group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("size", "at", "p")), asc=False).alias("units"), F.first("n").alias("n"))
        inputs = F.transform("units", lambda x: F.struct(x["at"].alias("at"), x["p"].alias("p"), x["size"].alias("size"), _draw(x["at"], x["size"], salt).alias("u")))
        levels.append(checkpoint(now.select("source", "g", "n", _fold(inputs).alias("fold"))))
        if most <= 1:
            break
    # the top's residual, if any, is drawn; then each level tells the one below what became of its residuals
    told = levels[-1].withColumn("up", F.when(_draw(F.col("source"), F.lit(seed)) < F.col("fold.rest.p"), 1).otherwise(0))
    for low in reversed(levels[:-1]):
        fates = told.select(F.col("source").alias("of"), F.explode(_fates()).alias("x")).select("of", F.col("x.at").alias("to"), F.col("x.up").alias("up"))
        told = low.join(fates, F.col("source").eqNullSafe(F.col("of")) & (F.col("g") == F.col("to")), "left").drop("of", "to")
    out = told.select("source", "source_size", "target", _fates().alias("fates"), F.posexplode("units").alias("at", "x"))
    up = F.filter("fates", lambda f: f["at"] == F.col("at"))[0]["up"]
    out = out.withColumn("copies", F.when(F.col("x.size") > 0, F.col("x.whole") + up).otherwise(0).cast("long"))
    kept = ("size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *own)
    out = out.select("x.doc_id", "x.size", "source_size", "target", "copies", *(f"x.{c}" for c in own)).select("doc_id", *kept)
    return out.unionByName(blank.withColumn("copies", F.lit(0).cast("long")).select("doc_id", *kept))


def _fates() -> Column:
    """(at, up) of all that a group folded, its residual among them."""
    rest = F.when(F.col("fold.rest").isNotNull(), F.array(F.struct(F.col("fold.rest.at").alias("at"), F.coalesce("up", F.lit(0)).alias("up"))))
    return F.concat("fold.done", F.coalesce(rest, F.array().cast("array<struct<at:bigint,up:int>>")))
