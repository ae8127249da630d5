"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles of ``words`` words (1 to 5). Two
sets link when ``100 * |A & B| >= percent * |A | B|``; the result names the
connected components. The defaults, 4 words and 85, are those of query op3.

Method. For one level of sizes the hash space of shingles is cut into ``k``
blocks, and a block's sketch word is the XOR of the shingle hashes that fall into
it. A differing shingle changes at most one word, so the number of differing
words is a lower bound of the symmetric difference. Linked sets of that level
differ in at most ``d`` shingles; with ``k > d`` blocks some word must be equal
(pigeonhole), and equal words are the join keys. Candidates are verified on the
exact sets.

Empty blocks would be equal everywhere and carry nothing, so they are no keys.
A set is *safe* under a hash seed when it has fewer than ``k - d`` empty blocks:
then each partner shares a non-empty word with it. A set emits the keys of seed
after seed up to its first safe one, so for each pair some seed has one safe
member and both emit; sets that no seed makes safe meet on the words of the last
seed, empty ones included, among themselves only. So no linked pair is lost.

Sizes fall into bands whose edges grow by ``100 / percent``. A pair lies in one band or in
two neighbouring ones; a set emits at its own level and as the larger partner at
the level below.

Scale. Documents with equal sets are one class from the start. A class spreads
over about a third as many keys as it has shingles, so a group of copies that
holds a third of all rows is dealt over many keys. Within a group pairs are never
emitted wholesale: Hamming distances of full bit sketches (as many bits as the
set has shingles) bound the symmetric difference from below and rule out what
cannot link before anything leaves the task. Of the rest, three rounds verify
each set with a leader of the groups of its smallest keys, then just enough pairs to join what is
still apart, and at last every pair that is still apart and may link; so no link
that matters to a component is lost, and links inside a component are not listed.
Near copies share a large part of their keys and meet in that many groups. Each set
brings its ``LOW_KEYS`` smallest keys along: sets with one smallest key are joined in
that key's group only, and at last a pair is told by no key above a shared one of
these. So the pairs of a group do not multiply by the keys that it shares.

Edge cases: texts with fewer words than a shingle have one, the whole sequence; null,
empty and blank texts have an empty set and link with nothing. Very long texts
have large sets like any other; of ties the smallest id names a component. Rows
with equal ids are one document that holds each of its texts: their links are
united. A null id takes no part in linking and gets a null component. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytehash
from tessella.llm.bytehash import LOWER, mix
from tessella.llm.common import Identities, discard, materialise, portable
from tessella.llm.components import connect

WORDS = 4
PERCENT = 85
SEEDS = 4
#: Spare blocks beyond the pigeonhole's need, at least; more make fewer sets unsafe.
SPARE = 4
#: Keys of each set that the first round of verification looks at.
FIRST_KEYS = 2
#: Smallest keys of each set that tell in which group a pair has its turn.
LOW_KEYS = 16


def band_edges(most: int, percent: int = PERCENT) -> list[int]:
    """Lower edges of size bands; two linked sizes lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        # the largest size that can link with edge - 1 items below stays out of the band after the next
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * 100 / percent)))
    return edges


def level_limits(edges: list[int], percent: int = PERCENT) -> np.ndarray:
    """For each level the most shingles in which linked sets with the smaller one in this band differ."""
    out = []
    for high in [*edges[1:], edges[-1] * 2]:
        union = (high - 1) * 100 // percent
        out.append(union * (100 - percent) // 100)
    return np.array(out, dtype=np.int64)


def level_blocks(edges: list[int], limits: np.ndarray) -> np.ndarray:
    """Blocks for each level: the fewest of which a set of the level's lowest size
    fills more than the limit, but for one in a hundred or so; such sets need one seed."""
    out = []
    for low, d in zip(edges, limits.tolist(), strict=True):
        k = np.arange(d + 1 + SPARE, 2 * d + 10 + SPARE, dtype=float)
        empty = k * np.exp(-low / k)
        enough = np.flatnonzero(k - empty - 2.5 * np.sqrt(empty) >= d + 1)
        out.append(int(k[enough[0]]) if len(enough) else d + 1 + SPARE)
    return np.array(out, np.int64)


def sketch_words(hashes: np.ndarray, rows: np.ndarray, blocks: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketch words of many sets at once: (row, block, word, first) by row and block.

    ``hashes`` are all sets' shingles, ``rows`` their set numbers and ``blocks``
    the number of blocks for each set.
    """
    m = mix(hashes, seed)
    block = ((m >> np.uint64(40)).astype(np.int64) * blocks[rows]) >> 24
    place = np.cumsum(blocks) - blocks
    slot = place[rows] + block
    order = np.argsort(slot, kind="stable")
    s = slot[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    words = np.bitwise_xor.reduceat(mix(hashes[order], seed + 17), starts) if len(s) else np.zeros(0, np.uint64)
    owner = rows[order][starts]
    return owner, s[starts] - place[owner], words, starts


def keys_of(hashes: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of sets given by their concatenated hashes and their sizes: (set, key)."""
    most = int(sizes.max(initial=0))
    edges = band_edges(max(most, 1), percent)
    limits = level_limits(edges, percent)
    blocks = level_blocks(edges, limits)
    band = np.searchsorted(np.array(edges), sizes, side="right") - 1
    every = np.repeat(np.arange(len(sizes)), sizes)
    sets, keys = [], []
    for below in (0, 1):
        level = band - below
        # with no shingle to spare only equal sets link, and those are one class
        use = (sizes > 0) & (level >= 0) & (limits[np.maximum(level, 0)] > 0)
        if below:  # the larger partner of a set in the band below
            low = np.array(edges)[np.maximum(level, 0)]
            high = np.array(edges)[np.minimum(np.maximum(level, 0) + 1, len(edges) - 1)] - 1
            use &= (sizes * percent <= high * 100) & (low > 0)
        left = use
        for seed in range(SEEDS + 1):
            if not left.any():
                break
            last = seed == SEEDS
            d = limits[np.maximum(level, 0)]
            k = np.where(left, blocks[np.maximum(level, 0)], 0)
            inside = left[every]
            owner, block, word, _ = sketch_words(hashes[inside], every[inside], k, min(seed, SEEDS - 1))
            filled = np.bincount(owner, minlength=len(sizes))
            if last:
                # unsafe under every seed: all words of the last seed, empty ones as 0
                rows = np.repeat(np.arange(len(sizes)), k)
                first = np.cumsum(k) - k
                every_block = np.arange(len(rows)) - first[rows]
                words = np.zeros(len(rows), np.uint64)
                words[first[owner] + block] = word
                owner, block, word = rows, every_block, words
            with np.errstate(over="ignore"):
                tag = mix(((level[owner].astype(np.uint64) << np.uint64(32)) | block.astype(np.uint64)) + (np.uint64(seed + 1) << np.uint64(56)), 5)
                sets.append(owner)
                keys.append(mix(word ^ tag, 11).view(np.int64))
            left = left & ~(k - filled < k - d)
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sets), np.concatenate(keys)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingle sets of a batch's texts: (first row, sets) chunk by chunk."""
    data, offsets = bytehash.text_bytes(batch.column("text"))
    for i, _, b, at in bytehash.chunks(data, offsets):
        yield i, bytehash.shingles(LOWER[b], at, words)


def _digest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes, sizes and a 128-bit digest of each set."""
    values = np.concatenate([*sets, np.zeros(0, np.uint64)])
    sizes = np.array([len(x) for x in sets], np.int64)
    place = np.r_[0, np.cumsum(sizes)]
    sums = [np.r_[np.uint64(0), np.cumsum(mix(values, seed))] for seed in (101, 202)]
    one, two = ((c[place[1:]] - c[place[:-1]]).view(np.int64) for c in sums)
    return values, sizes, one, two


def _digests(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sets in _sets(batch, words):
            _, sizes, one, two = _digest(sets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(sets)), pa.array(sizes), pa.array(one), pa.array(two)], names=["doc_id", "n", "d1", "d2"])


def _keys(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Join keys with the first digest of their set, once per batch for equal sets."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        for _, sets in _sets(batch, words):
            _, _, one, two = _digest(sets)
            new = [i for i, d in enumerate(zip(one.tolist(), two.tolist(), strict=True)) if d not in seen and not seen.add(d)]
            kept = [sets[i] for i in new]
            owner, key = keys_of(np.concatenate([*kept, np.zeros(0, np.uint64)]), np.array([len(x) for x in kept], np.int64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(one[new][owner])], names=["key", "rep"])


def bit_sketch(values: np.ndarray) -> bytes:
    """Parity bits of a set: each hash flips one of at least as many bits as the set has members."""
    bits = max(64, 1 << (len(values) - 1).bit_length())
    flips = np.bincount((mix(values, 77) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the shortest one's size."""
    size = min(map(len, sketches))
    out = np.empty((len(sketches), size // 8), np.uint64)
    for i, x in enumerate(sketches):
        w = np.frombuffer(x, np.uint64)
        while len(w) * 8 > size:  # the parity of both halves is the parity sketch of half the size
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _close(words: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Which of the others may link with set i, and their Hamming distances."""
    far = np.bitwise_count(words[others] ^ words[i]).sum(axis=1, dtype=np.int64)
    both = sizes[others] + sizes[i]
    low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    # linked sets differ in at most (100 - P) / (100 + P) of their sizes' sum, and the distance is never more than that
    return (far * (100 + percent) <= both * (100 - percent)) & (low * 100 >= high * percent), far


def _leaders(rep: np.ndarray, words: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Each set with the closest leader that may link with it; others become leaders."""
    leaders: list[int] = []
    for i in range(len(rep)):
        if leaders:
            at = np.array(leaders)
            good, far = _close(words, sizes, i, at, percent)
            if good.any():
                yield int(rep[at[np.argmin(np.where(good, far, 1 << 40))]]), int(rep[i])
                continue
        leaders.append(i)


def _across(rep: np.ndarray, comp: np.ndarray, words: np.ndarray, sizes: np.ndarray, earlier: list[list[int]], forest: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs across components that may link: all, or just enough to join what they can join.

    ``earlier`` are keys of each set below the group's own, in order. Of all pairs those
    that share one have their turn there; to join them, sharing the first one suffices,
    as what stays apart comes up again among all pairs.
    """
    parent = {c: c for c in set(comp.tolist())}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if forest:
        first: dict[int, int] = {}
        for c, keys in zip(comp.tolist(), earlier, strict=True):
            if keys:
                parent[root(c)] = root(first.setdefault(keys[0], c))
        comp = np.array([root(c) for c in comp.tolist()])
    had = [set(keys) for keys in earlier]
    for i in range(1, len(rep)):
        before = np.flatnonzero(comp[:i] != comp[i])
        if not len(before):
            continue
        good, far = _close(words, sizes, i, before, percent)
        for j in before[good][np.argsort(far[good], kind="stable")].tolist():
            if forest:
                a, b = root(int(comp[i])), root(int(comp[j]))
                if a == b:
                    continue
                parent[a] = b
            elif not had[i].isdisjoint(had[j]):
                continue
            yield int(rep[j]), int(rep[i])


def _group_pairs(batches: Iterator[pa.RecordBatch], mode: str, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each key's sets, from rows sorted by key and set."""
    import itertools

    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "rep", "comp", "n", "sketch", "lows")), strict=True))
    told: set[tuple[int, int]] = set()
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        _, rep, comp, n, sketch, lows = zip(*group, strict=True)
        if len(rep) < 2:
            continue
        reps, comps, sizes, words = np.array(rep), np.array(comp), np.array(n), _folded(list(sketch))
        earlier = [[k for k in x if k < key] for x in lows]
        told.update(_leaders(reps, words, sizes, percent) if mode == "leaders" else _across(reps, comps, words, sizes, earlier, mode == "forest", percent))
        if len(told) > 1 << 16:
            yield _pair_batch(told)
            told = set()
    if told:
        yield _pair_batch(told)


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _members(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sets in _sets(batch, words):
            values, sizes, _, _ = _digest(sets)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)))
            sketches = pa.array([bit_sketch(x) for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(sets)), pa.array(sizes), sketches, lists], names=["rep", "n", "sketch", "shingles"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated values and list sizes of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes.astype(np.int64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two or more sets hold, from rows sorted by key and set.

    Keeps one row between batches, whatever the size of a group is.
    """
    held: tuple[int, int] | None = None
    told = False
    for b in batches:
        key, rep = b.column("key").to_numpy(), b.column("rep").to_numpy()
        if not len(key):
            continue
        if held is not None:
            key, rep = np.r_[held[0], key], np.r_[held[1], rep]
        keep = np.r_[True, (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])]
        if held is not None and told:
            was = True
        else:
            was = False
        key, rep = key[keep], rep[keep]
        same_next = np.r_[key[1:] == key[:-1], False]
        same_prev = np.r_[False, key[1:] == key[:-1]]
        out = same_next | same_prev
        if was:
            out[0] = False  # told with the batch before
        last_out = bool(out[-1]) or (was and len(key) == 1)
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(rep[out])], names=["key", "rep"])
        held, told = (key[-1], rep[-1]), last_out


def _by_key(rows: DataFrame) -> DataFrame:
    """Rows with all of a key in one task, sorted by key and set.

    They are dealt by an expression that no join deals by: after a join on the key, a
    plain repartition by it is left out of the plan, and the adaptive plan may then
    read that join's shuffle in pieces that split a key.
    """
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key", "rep")


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        xa, na = _flat(b.column("sa"))
        xb, nb = _flat(b.column("sb"))
        m = len(na)
        # sets have distinct members, so in each pair a value occurs twice exactly if it is shared
        rows = np.r_[np.repeat(np.arange(m), na), np.repeat(np.arange(m), nb)]
        values = np.r_[xa, xb]
        order = np.lexsort((values, rows))
        r, v = rows[order], values[order]
        both = np.bincount(r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])], minlength=m) if len(r) else np.zeros(m, np.int64)
        good = pa.array(100 * both >= percent * (na + nb - both))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(good), b.column("b").filter(good)], names=["a", "b"])


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``."""
    names = Identities(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    out = _link(names.rows, words, percent, names.most)
    return names.back(out, "doc_id", "component_id").select("doc_id", "n_shingles", "component_id")


def _link(base: DataFrame, words: int, percent: int, most: int = 1) -> DataFrame:
    """``link`` on rows whose ids have one text each; the ``most`` ids from each
    multiple of it on are one document, whose texts' links are united."""
    digests = materialise(base.mapInArrow(lambda it: _digests(it, words), "doc_id long, n long, d1 long, d2 long"), "jaccard-sets")
    known = digests.where("n > 0 and doc_id is not null")
    classes = materialise(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")

    # sorted by key, a group of any size streams through; copies within a batch are one row already
    keyed = base.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(lambda it: _keys(it, words, percent), "key long, rep long")
    shared = keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shared, "key long, rep long")
    # should two classes have equal first digests, both become candidates and verification tells them apart
    digest = classes.select(F.col("d1"), F.col("rep").alias("id"))
    groups = materialise(shared.join(digest, shared.rep == digest.d1).select("key", F.col("id").alias("rep")).distinct(), "jaccard-groups")
    wanted = groups.select(F.col("rep").alias("wanted")).distinct()
    members = materialise(base.join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi").mapInArrow(lambda it: _members(it, words), "rep long, n long, sketch binary, shingles array<long>"), "jaccard-members")

    found = base.sparkSession.createDataFrame([], "a long, b long")
    if most > 1:  # a document with several texts ties their classes together
        own = known.withColumn("o", F.col("doc_id") - F.pmod("doc_id", F.lit(most))).join(classes, ["n", "d1", "d2"]).select("o", "rep").distinct()
        low = own.groupBy(F.col("o").alias("o_")).agg(F.min("rep").alias("a"))
        found = materialise(own.join(low, F.col("o") == F.col("o_")).where("rep <> a").select("a", F.col("rep").alias("b")), "jaccard-ties")
    labels = connect(found)
    sketched = members.select(F.col("rep").alias("id"), "n", "sketch")
    # first sets meet leaders of their groups; then what is left apart meets across
    # components, at first only as far as needed to join them, at last completely
    # the smallest keys of a set are a min-hash of its keys: copies share them, so the
    # first round looks only there, and the later rounds at every group
    lows = materialise(groups.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list("key")), 1, LOW_KEYS).alias("lows")).select(F.col("rep").alias("low_rep"), "lows"), "jaccard-lows")
    firsts = lows.select(F.col("low_rep").alias("rep"), F.explode(F.slice("lows", 1, FIRST_KEYS)).alias("key"))
    for mode in ("leaders", "forest", "all"):
        seen = firsts if mode == "leaders" else groups
        tagged = seen.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("comp"))
        spread = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") < F.col("hi")).select(F.col("key").alias("open_key"))
        open_rows = tagged.join(spread, F.col("key") == F.col("open_key"), "left_semi")
        full_rows = open_rows.join(sketched, F.col("rep") == F.col("id")).join(lows, F.col("rep") == F.col("low_rep")).select("key", "rep", "comp", "n", "sketch", "lows")
        pairs = _by_key(full_rows).mapInArrow(lambda it, m=mode: _group_pairs(it, m, percent), "a long, b long").distinct()
        left = members.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
        right = members.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
        full = pairs.join(left, "a").join(right, "b")
        verified = materialise(full.select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, percent), "a long, b long"), "jaccard-links")
        found = found.unionByName(verified)
        labels = connect(found)
    discard(groups, members, lows)
    classed = classes.select("n", "d1", "d2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(F.col("n").alias("cn"), F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.coalesce("label", "rep").alias("comp"))
    out = digests.join(classed, (F.col("n") == F.col("cn")) & (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each group of linked texts: the smallest id.

    Every text is judged on its own: rows with one id and different texts are
    different documents, and only those that another row stands for go (among
    texts of one id the one of the smaller hash stays). Of rows that are equal in
    id and text one stays. Rows without an id stay.
    """
    names = Identities(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    linked = _link(names.rows, words, percent)
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    place = F.pmod("doc_id", F.lit(names.most)).cast("long")
    gone = names.back(gone.withColumn("place", place), "doc_id").select(F.col("doc_id").alias("__tessella_gone"), F.col("place").alias("__tessella_gone_place"))
    again = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__tessella_again")).count().where("count > 1").select("__tessella_again")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = names.placed(docs.select(*own, F.col(doc_id).cast("long").alias("__tessella_id")), "__tessella_id", text)
    left = rows.join(gone, (F.col("__tessella_id") == F.col("__tessella_gone")) & (F.col("__tessella_place") == F.col("__tessella_gone_place")), "left_anti")
    # only rows of repeated ids are compared with each other
    repeated = left.join(again, F.col("__tessella_id") == F.col("__tessella_again"), "left_semi").dropDuplicates(["__tessella_id", "__tessella_place"])
    single = left.join(again, F.col("__tessella_id") == F.col("__tessella_again"), "left_anti")
    return single.unionByName(repeated).select(*own)


portable(__name__)
