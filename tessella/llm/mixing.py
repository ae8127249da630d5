"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the fractional copy count of its source (target words
over source words, at most 2). The whole part is taken at once; the fractional
parts are rounded pivotally: two parties exchange *words* (probability times
size), in a random direction with unbiased odds, until one of them is integral.
So each exchange keeps the source's word count exactly, and every party's
expectation.

Exchanges form a distributed reduction tree, the same one at every size.
Documents are dealt into blocks of about ``block``. In a block the largest
document is paired with all smaller ones together, then the next; these still
have one common probability, which is the fold's state. A document leaves the
pair at 0 or 1, unless its smaller partners become integral first. So one
document of the block stays open, nearly always its smallest. The open documents
go up and are folded pairwise in blocks again, level by level, until each source
has one, and the root decides it with its own odds. A source's words therefore
miss the target by the rounding of one small document. All random choices are
hashes of ids and seed, so reruns agree. A hot source just has more blocks.

Edge cases: null text has size 0 and takes 0 words; null is a source of its own
and comes last; null ids are allowed; repeated rows (equal id, source and size)
share one decision; documents of equal size are ordered by a hash of their ids;
a very long text is one narrow row like any other, and in a source where it
outweighs all others together it may be left to the root; an empty table gives
an empty result; a source without words has target 0. Extra columns are carried
through by ``repeat``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, materialise, numbered, word_array

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 512
SCALE = 1 << 16
SEED = 20240601
#: Rows of a source meet its target over this many keys where the targets are too many to broadcast.
SALTS = 64

_OPEN = "struct<id:bigint,full:bigint,mass:double>"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, n_rows, target`` from rows of ``source, size``.

    Targets are ``min(cap * size, level * weight)``. The level starts where it
    spends the share over all weights; what sources at their stop leave over is
    reshared among the rest until none is above. A round is one aggregate to two
    numbers; sources are ranked without a window over all of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = numbered(per, F.col("source")).withColumns({"weight": weight, "most": F.col("source_size") * cap})
    per = materialise(per.drop("place"), "mix-sources", "none")
    words = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("most") < F.col("weight") * level
        spent, left = per.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not left:
            break
        raised = (share * words - (spent or 0)) / left
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return per.select("source", "source_size", "n_rows", F.least(F.col("most").cast("double"), F.col("weight") * level).alias("target"))


def _item(doc_id: Column, source: Column, size: Column) -> Column:
    return F.xxhash64(doc_id, F.coalesce(source, F.lit("\0null")), size)


def _unit(seed: int, *cols: Column) -> Column:
    """A uniform value in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52).cast("long")).cast("double") / float(1 << 52)


def _one(taken: Column, item: Column) -> Column:
    return F.when(taken, F.array(item)).otherwise(F.array().cast("array<bigint>"))


def leaf(items: Column, part: Column, seed: int = SEED) -> Column:
    """Fold a block of documents (id, full), largest first, that have one common probability.

    The result has the open document, if any, and the ids decided as 1.
    """
    whole = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["full"])
    start = F.struct(part.alias("q"), whole.alias("rest"), F.lit(None).cast(_OPEN).alias("open"), F.array().cast("array<bigint>").alias("ones"))

    def step(s: Column, x: Column) -> Column:
        # the parties' sums are structs of their own, so that each is computed once
        def pair(v: Column) -> Column:
            full, rest, q = x["full"].cast("double"), (s["rest"] - x["full"]).cast("double"), s["q"]
            up, down = F.least(full - q * full, q * rest), F.least(q * full, rest - q * rest)
            return F.struct(full.alias("full"), rest.alias("rest"), up.alias("up"), down.alias("down"), (_unit(seed, x["id"], F.lit("leaf")) * (up + down) < down).alias("rises"))

        def state(v: Column) -> Column:
            q, full, rest = s["q"], v["full"], v["rest"]
            one = v["rises"] & (full - q * full <= q * rest)
            zero = ~v["rises"] & (q * full <= rest - q * rest)
            mass = q * full + F.when(v["rises"], v["up"]).otherwise(-v["down"])
            shifted = F.when(rest > 0, q + F.when(v["rises"], -v["up"]).otherwise(v["down"]) / rest).otherwise(q)
            moved = F.when(one | zero, F.greatest(F.least(shifted, F.lit(1.0)), F.lit(0.0))).otherwise(F.when(v["rises"], F.lit(0.0)).otherwise(F.lit(1.0)))
            # once a document is open, its smaller partners are all at 0 or all at 1
            left = F.when(s["open"].isNotNull(), s["open"]).when(~one & ~zero, F.struct(x["id"].alias("id"), x["full"].alias("full"), mass.alias("mass")))
            return F.struct(
                F.when(s["open"].isNotNull(), q).otherwise(moved).alias("q"),
                (s["rest"] - x["full"]).alias("rest"),
                left.alias("open"),
                F.concat(s["ones"], _one(F.when(s["open"].isNotNull(), q > 0.5).otherwise(one), x["id"])).alias("ones"),
            )

        return F.get(F.transform(F.transform(F.array(F.lit(0)), pair), state), 0)

    return F.aggregate(items, start, step)


def fold(items: Column, seed: int = SEED) -> Column:
    """Fold open documents (id, full, mass) pairwise; all in exact integers of ``1 / SCALE`` words."""
    kind = "struct<id:bigint,full:bigint,mass:bigint>"
    none = F.lit(None).cast(kind)
    start = F.struct(none.alias("open"), F.array().cast("array<bigint>").alias("ones"))

    def item(i: Column, full: Column, mass: Column) -> Column:
        return F.struct(i.alias("id"), full.alias("full"), mass.alias("mass"))

    def step(state: Column, x: Column) -> Column:
        a, ones = state["open"], state["ones"]
        to_a = F.least(a["full"] - a["mass"], x["mass"])
        to_x = F.least(a["mass"], x["full"] - x["mass"])
        # words go to a with odds to_x : to_a, so the expectation of both stays
        shift = F.when(_unit(seed, a["id"], x["id"]) * (to_a + to_x).cast("double") < to_x.cast("double"), to_a).otherwise(-to_x)
        new_a, new_x = a["mass"] + shift, x["mass"] - shift
        done_a = (new_a == 0) | (new_a == a["full"])
        done_x = (new_x == 0) | (new_x == x["full"])
        left = F.when(~done_a, item(a["id"], a["full"], new_a)).when(~done_x, item(x["id"], x["full"], new_x)).otherwise(none)
        more = F.concat(ones, _one(done_a & (new_a == a["full"]), a["id"]), _one(done_x & (new_x == x["full"]), x["id"]))
        return F.when(a.isNull(), F.struct(item(x["id"], x["full"], x["mass"]).alias("open"), ones.alias("ones"))).otherwise(F.struct(left.alias("open"), more.alias("ones")))

    return F.aggregate(items, start, step)


def _taken(items: DataFrame, most: int, block: int, seed: int) -> DataFrame:
    """``source, item`` of all documents of ``source, item, words, part, n`` that round up;
    ``most`` is the largest ``n``, the rows of a source."""
    ones, written, level, width = [], [], 0, 1
    while level == 0 or width < most:
        width *= block
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(width))).cast("long"), F.lit(1).cast("long"))
        dealt = items.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "item"), blocks))
        if level == 0:
            members = F.sort_array(F.collect_list(F.struct((-F.col("words")).alias("k"), F.xxhash64(F.lit(seed), "item").alias("o"), F.col("item").alias("id"), F.col("words").alias("full"))))
            grouped = dealt.groupBy("source", "block").agg(members.alias("items"), F.first("n").alias("n"), F.first("part").alias("part"))
            done = leaf(F.col("items"), F.col("part"), seed)
        else:
            members = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "item").alias("o"), F.col("item").alias("id"), "full", "mass")))
            grouped = dealt.groupBy("source", "block").agg(members.alias("items"), F.first("n").alias("n"))
            done = fold(F.col("items"), seed)
        folded = materialise(grouped.select("source", "n", done.alias("f")).select("source", "n", "f.open", "f.ones"), f"mix-level{level}", "none")
        written.append(folded)
        ones.append(folded.select("source", F.explode("ones").alias("item")))
        full, mass = F.col("open.full"), F.col("open.mass")
        if level == 0:
            full = full * SCALE
            mass = F.least(F.greatest(F.round(mass * SCALE).cast("long"), F.lit(0).cast("long")), full)
        items = folded.where("open is not null").select("source", F.col("open.id").alias("item"), full.alias("full"), mass.alias("mass"), "n")
        level += 1
    # one open document is left of each source; the root decides it with its own odds
    up = items.where(_unit(seed, F.col("item"), F.lit("root")) * F.col("full") < F.col("mass")).select("source", "item")
    for more in ones:
        up = up.unionByName(more)
    up = materialise(up, "mix-taken", "none")
    discard(*written)
    return up


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for each row.

    The item of a decision is the hash of id, source and size; rows that are
    alike in all three are one item with their common words.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(word_array(F.col(text))).cast("long").alias("size"))
    # the texts are read once; what follows works on these narrow rows
    sized = materialise(sized.withColumn("item", _item(F.col("doc_id"), F.col("source"), F.col("size"))), "mix-sizes", "none")
    targets = source_targets(sized, weights, share, cap)
    # a source of a third of all rows meets its target over many keys, where the targets are no broadcast
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target", "n_rows", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t_salt"))
    key = F.col("source").eqNullSafe(F.col("t_source")) & (F.pmod("item", F.lit(SALTS)).cast("int") == F.col("t_salt"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(named, key, "left").drop("t_source", "t_salt").withColumn("rate", rate)
    rows = rows.withColumn("whole", F.least(F.floor(F.col("rate") + 1e-12), F.lit(cap)).cast("long"))
    part = F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))
    rows = rows.withColumn("part", F.when(part > 1e-9, part).otherwise(F.lit(0.0)))

    items = rows.where((F.col("part") > 0) & (F.col("size") > 0)).groupBy("source", "item").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("n_rows").alias("n"))
    up = _taken(items, targets.agg(F.max("n_rows")).first()[0] or 0, block, seed)
    # the join's first key is the item, so a hot source is spread
    up = up.select(F.col("item").alias("up_item"), F.col("source").alias("up_source"), F.lit(1).cast("long").alias("up"))
    out = rows.join(up, (F.col("item") == F.col("up_item")) & F.col("source").eqNullSafe(F.col("up_source")), "left")
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", "item", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies."""
    mixed = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    # alike rows are one item, so the texts meet a row per item; the hash spreads a hot source
    taken = mixed.where("copies > 0").groupBy(F.col("item").alias("__tessella_taken")).agg(F.max("copies").alias("__tessella_copies"))
    item = _item(F.col(doc_id), F.col(source), F.size(word_array(F.col(text))).cast("long"))
    rows = docs.withColumn("__tessella_item", item).join(taken, F.col("__tessella_item") == F.col("__tessella_taken"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__tessella_copies"))).alias("__tessella_copy")).drop("__tessella_copy")
