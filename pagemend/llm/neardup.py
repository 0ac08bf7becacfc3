"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are its runs of ``K`` words, labelled with their occurrence number so that repeats count.  Each of ``SKETCHES``
hash orders samples the ``PICKS`` smallest labelled k-mers and keeps them in text order; two documents with an equal sample are
candidates.  Unlike plain MinHash the sample remembers order, so it follows edit similarity and not only the set of k-mers.

Candidates are compared by a banded alignment of their words: a longest common subsequence inside the band that any pair at the
threshold must stay in, similarity ``2 * common / (words a + words b)``.  Pairs of ``SIMILARITY`` or more are links; documents
joined by links are a class, named by its smallest id.

``K``, ``PICKS`` and ``SKETCHES`` are set for the threshold: at an alignment of 0.8 by words replaced all over a text the labelled
word pairs agree to 0.47, and such a pair meets in a sample with probability ``1 - (1 - 0.47 ** 3) ** 40``, 0.98 and more.

Equal texts are collapsed first; a node is a distinct text.  In a few of the samples each text is compared with the leader of its
buckets, and then, in all buckets that hold more than one class, with the first and the last member: so classes of copies come
together cheaply.  Then every pair of a bucket that is still of two classes is compared, in buckets of any size: those of more than
``AT_ONCE`` texts are not expanded into pairs of rows, but blocks of them meet block by block, where bounds that any pair at the
threshold must reach rule most pairs out, the others are aligned, and pairs joined meanwhile are left out.

A row of the result is a distinct (id, text).  Ids are of any type that can be ordered; null ids are ids like others and come last.
One id with two texts is two rows.  Null texts are each alone.  Texts without a word are only equal to themselves, byte for byte.
Texts of fewer than ``K`` words are one k-mer.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import released
from .common import FOLD, fold_words, map_rows, settle, small, table

#: Words of a k-mer.
K = 2
#: Hash orders, and labelled k-mers that each samples.
SKETCHES, PICKS = 40, 3
#: Members of a bucket whose pairs are written out as rows; larger buckets are compared in blocks.
AT_ONCE = 32
#: Documents of a block, and bytes of their texts, about.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Lowest similarity of a link.
SIMILARITY = 0.8

_BASE = np.uint64(0x100000001B3)
_UNBASE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        _POWERS["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
        _POWERS["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _UNBASE, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each folded word, in order, without a Python loop over words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(FOLD), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    solid = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def kmer_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of k words; the whole text if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i]
    return mix(out)


def labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer hash with the number of its occurrence (0 for the first) mixed in."""
    order = np.argsort(kmers, kind="stable")
    ranked = kmers[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    nth = np.arange(len(kmers)) - np.maximum.accumulate(np.where(fresh, np.arange(len(kmers)), 0))
    label = np.empty(len(kmers), np.uint64)
    label[order] = nth.astype(np.uint64)
    return mix(kmers + mix(label * np.uint64(0xBF58476D1CE4E5B9)) * (label > 0))


def seeds_of(lo: int, hi: int) -> np.ndarray:
    """The seeds of hash orders ``lo`` to ``hi``, exclusive."""
    return (np.arange(lo + 1, hi + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)


def sketch(text: str | None, k: int = K, sketches: int = SKETCHES, picks: int = PICKS) -> list[int]:
    """One signed 64-bit signature for each hash order; empty without words."""
    kmers = kmer_hashes(word_hashes(text), k)
    if not len(kmers):
        return []
    kmers = labelled(kmers)
    out = np.empty(sketches, np.uint64)
    at_once = max(1, (1 << 18) // len(kmers))  # hash orders computed together
    for lo in range(0, sketches, at_once):
        seeds = seeds_of(lo, min(lo + at_once, sketches))[:, None]
        ranks = (kmers ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
        ranks ^= ranks >> np.uint64(29)
        ranks *= np.uint64(0x94D049BB133111EB)
        chosen = np.sort(np.argpartition(ranks, picks - 1, axis=1)[:, :picks], axis=1) if len(kmers) > picks else np.broadcast_to(np.arange(len(kmers)), (len(seeds), len(kmers)))
        value = seeds[:, 0].copy()
        for pick in range(chosen.shape[1]):
            value = (value ^ (value >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + kmers[chosen[:, pick]]
        out[lo : lo + len(seeds)] = value
    return mix(out).astype(np.int64).tolist()


def common_length(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose matches stay within ``band`` places of the diagonal (bit-parallel)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return start + end
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row, narrow = whole, band < len(a)
    for j, word in enumerate(b):
        match = places.get(word, 0)
        if match and narrow:
            low = max(0, j - band)
            match = (match >> low & (1 << (j + band + 1 - low)) - 1) << low
        if match:
            hit = row & match
            row = (row + hit) | (row & ~match)
    return start + end + len(a) - (row & whole).bit_count()


def similar(a: str, b: str, at_least: float = SIMILARITY) -> bool:
    """Whether the alignment of the words of two texts reaches ``at_least``."""
    x, y = a.encode("utf-8", "surrogatepass").translate(FOLD).split(), b.encode("utf-8", "surrogatepass").translate(FOLD).split()
    total = len(x) + len(y)
    if 2 * min(len(x), len(y)) < at_least * total:
        return False
    spare: dict = {}
    for word in x:
        spare[word] = spare.get(word, 0) + 1
    shared = 0
    for word in y:
        left = spare.get(word, 0)
        if left:
            spare[word] = left - 1
            shared += 1
    if 2 * shared < at_least * total:
        return False
    # insertions and deletions at the threshold: |i - j| cannot exceed half of their number and of the length difference
    edits = int(total * (1 - at_least)) + 1
    band = (edits + abs(len(x) - len(y))) // 2 + 1
    return 2 * common_length(x, y, band) >= at_least * total


def sketches_of(docs: DataFrame, text_col: str, k: int, sketches: int, picks: int) -> DataFrame:
    """(same: hash of the text, n_words, size in bytes, sigs) of every text that is not null."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.sha2(text.cast("binary"), 256).alias("same"), F.octet_length(text).alias("size"), text.alias("text"))

    def setup():
        return lambda same, size, text: (same, len(fold_words(text)), size, sketch(text, k, sketches, picks))

    return map_rows(rows, ["same", "size", "text"], "same string, n_words int, size int, sigs array<long>", setup)


def reaches(words_a: Column, words_b: Column, at_least: float) -> Column:
    """Whether texts of these lengths can reach a similarity at all."""
    return 2 * F.least(words_a, words_b) >= at_least * (words_a + words_b)


def verified(pairs: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """(a, b, linked) for pairs of nodes, by alignment of their texts."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return map_rows(both, ["a", "b", "text_a", "text_b"], "a long, b long, linked boolean", lambda: lambda a, b, x, y: (a, b, similar(x, y, at_least)))


def classes_of(links: DataFrame) -> DataFrame:
    """(node, label) of all linked nodes: the smallest id reachable.

    Each round lets every node point to its smallest neighbour, follows the pointers, and goes on with the links between the
    places reached.  The first round follows three steps, which ends it for stars; later rounds follow to the very end, so what
    is left shrinks at least by half in each.
    """
    edges = settle(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, rounds = None, 0
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
        up = settle(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("top")))
        up = settle(further(further(up))) if not rounds else followed(up)
        labels = up.withColumnRenamed("top", "label") if labels is None else settle(relabel(labels, "label", up.withColumnRenamed("top", "label")))
        moved = edges.join(up.select(F.col("node").alias("a"), F.col("top").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("top").alias("y")), "b")
        edges = settle(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        rounds += 1
        released(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def further(up: DataFrame) -> DataFrame:
    """Every pointer replaced by that of the node it points to; all ends are nodes."""
    return up.join(up.select(F.col("node").alias("top"), F.col("top").alias("next")), "top").select("node", F.col("next").alias("top"))


def followed(up: DataFrame) -> DataFrame:
    """Pointers followed until none moves."""
    while True:
        fresh = settle(up.join(up.select(F.col("node").alias("top"), F.col("top").alias("next")), "top"))
        up = fresh.select("node", F.col("next").alias("top"))
        if fresh.where("next <> top").isEmpty():
            return up


def relabel(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``df`` with a column's nodes replaced by their labels; nodes without one stay."""
    found = labels.select(F.col("node").alias(column), F.col("label").alias("__label"))
    return df.join(found, column, "left").withColumn(column, F.coalesce("__label", column)).drop("__label")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links, which are first drawn between the classes that they join."""
    wider = classes_of(relabel(relabel(links, "a", labels), "b", labels))
    return settle(relabel(labels, "label", wider).unionByName(wider.join(labels.select("node"), "node", "left_anti")))


def mixed(members: DataFrame) -> DataFrame:
    """Buckets that hold nodes of two and more classes: their size, their first and last member and those members' labels."""
    found = members.groupBy("sig").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("node").alias("lead"), F.max("node").alias("last"), F.min_by("label", "node").alias("lead_label"), F.max_by("label", "node").alias("last_label"),
        F.min("label").alias("lo"), F.max("label").alias("hi"),
    )
    return found.where("lo <> hi").drop("lo", "hi")


def compared(rest: DataFrame, buckets: DataFrame, tried: DataFrame, texts: DataFrame, at_least: float) -> DataFrame:
    """Links found by comparing each with each in these buckets, but for the pairs ``tried``."""
    few = rest.join(buckets.select("sig"), "sig", "left_semi")
    side = lambda node, label, words: few.select("sig", F.col("node").alias(node), F.col("label").alias(label), F.col("n_words").alias(words))
    twos = side("a", "x", "wa").join(side("b", "y", "wb"), "sig").where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & reaches(F.col("wa"), F.col("wb"), at_least))
    pairs = twos.select("a", "b").distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return settle(verified(pairs, texts, at_least).where("linked").select("a", "b"))


def possible(hashes: list[np.ndarray], at_least: float) -> np.ndarray:
    """Pairs of texts, by their word hashes, that may reach ``at_least``; no pair that does is left out.

    Of ``common`` aligned words all but one start a shared pair of words, unless another word stands between in one of the texts:
    at least ``3 * common - 1 - total`` pairs of words are shared, and twice the shorter length is no less than ``2 * common``.
    """
    n = len(hashes)
    sizes = np.array([len(x) for x in hashes])
    total = sizes[:, None] + sizes
    pairs = [labelled(kmer_hashes(x, 2)) if len(x) > 1 else x[:0] for x in hashes]
    owner = np.repeat(np.arange(n), [len(x) for x in pairs])
    _, place, count = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    often = count > 1
    number = np.cumsum(often) - 1
    owner, place = owner[often[place]], number[place[often[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(often.sum()), 2048):
        cut = slice(*np.searchsorted(place, (lo, lo + 2048)))
        part = np.zeros((n, 2048), np.float32)
        part[owner[cut], place[cut] - lo] = 1
        shared += part @ part.T
    return (shared + 1 + 1e-6 * total >= (1.5 * at_least - 1) * total) & (2 * np.minimum(sizes[:, None], sizes) >= at_least * total)


def links_of_blocks(ids: list, labels: list, blocks: list, sigs: list, texts: list, band: int, at_least: float) -> list[tuple[int, int]]:
    """Links between two blocks of a bucket, or within one, enough to join all that are alike; pairs of an earlier bucket are left to that."""
    open_pairs = np.triu(possible([word_hashes(t) for t in texts], at_least), 1)
    label, block, sigs = np.array(labels), np.array(blocks), np.array(sigs)
    open_pairs &= label[:, None] != label
    if len(set(blocks)) > 1:
        open_pairs &= block[:, None] != block
    for earlier in range(band):
        open_pairs &= sigs[:, earlier, None] != sigs[:, earlier]
    top = {x: x for x in labels}

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    links = []
    for i, j in np.argwhere(open_pairs).tolist():
        x, y = root(labels[i]), root(labels[j])
        if x != y and similar(texts[i], texts[j], at_least):
            top[max(x, y)] = min(x, y)
            links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return links


def compared_in_blocks(rest: DataFrame, buckets: DataFrame, nodes: DataFrame, texts: DataFrame, at_least: float, block: int) -> DataFrame:
    """Links found by comparing each with each in these buckets, block by block."""
    many = buckets.select("sig", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
    held = rest.join(many, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("sig", "band", "node", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    held = held.join(nodes.select("node", "sigs").join(held.select("node").distinct(), "node", "left_semi").join(texts, "node"), "node")

    def run(rows):
        import pyarrow as pa

        column = lambda name: rows[name].to_pylist()
        links = []
        if rows["p"][0].as_py() == rows["q"][0].as_py() or len(set(column("block"))) > 1:  # not a block that has no partner
            links = links_of_blocks(*(column(x) for x in ("node", "label", "block", "sigs", "text")), rows["band"][0].as_py(), at_least)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return settle(held.groupBy("sig", "p", "q").applyInArrow(run, "a long, b long").distinct())


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, sketches: int = SKETCHES, picks: int = PICKS, at_least: float = SIMILARITY, at_once: int = AT_ONCE, block: int = BLOCK
) -> DataFrame:
    """``(id_col, same, copies, class_id, class_same)``: a row for each distinct (id, text), of ``copies`` rows; ``same`` is the SHA-256 of the text.

    ``class_id`` and ``class_same`` are those of the class's first row, by id and then by ``same``, and so tell classes apart even
    where one id has several texts.
    """
    # a node is a distinct text; its number is fixed by being written
    nodes = settle(sketches_of(docs, text_col, k, sketches, picks).groupBy("same").agg(F.first("n_words").alias("n_words"), F.first("size").alias("size"), F.first("sigs").alias("sigs")).withColumn("node", F.monotonically_increasing_id()))
    every = nodes.select("node", "n_words", "size", F.posexplode("sigs").alias("band", "sig"))
    crowded = every.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(every.join(crowded.select("sig"), "sig", "left_semi"))  # whoever shares a bucket with another text
    involved = small(settle(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "same")))
    texts = docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias("same"), F.col(text_col).alias("text")).join(involved, "same")
    texts = settle(texts.dropDuplicates(["node"]).select("node", "text"))
    released(docs.sparkSession)

    def labelled_by(labels: DataFrame) -> DataFrame:
        return relabel(members.withColumn("label", F.col("node")), "label", labels)

    # in a few bands, each text with the smallest leader of its buckets: copies come together by one comparison a text
    start = members.where(F.col("band") < max(1, sketches // 4)).withColumn("label", F.col("node"))
    first = start.join(mixed(start).select("sig", "lead"), "sig").where("node <> lead").groupBy("node").agg(F.min("lead").alias("a"))
    links = settle(verified(first.select("a", F.col("node").alias("b")), texts, at_least)).where("linked").select("a", "b")
    label = classes_of(links)
    # in all bands, what is not yet of one class with the bucket's first or last member
    rest = settle(labelled_by(label))
    released(docs.sparkSession)
    strange = rest.join(mixed(rest), "sig").where("label <> lead_label and label <> last_label or node = last and label <> lead_label")
    pairs = strange.select(F.explode(F.array(F.struct(F.col("lead").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("last").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()
    tried = settle(verified(pairs, texts, at_least))
    released(docs.sparkSession)
    label = joined(label, tried.where("linked").select("a", "b"))
    # whatever two classes still meet in a bucket, every pair of theirs
    rest = labelled_by(label)
    buckets = settle(mixed(rest).select("sig", "n", "bytes"))
    rest = settle(rest.join(buckets.select("sig"), "sig", "left_semi"))
    large = (F.col("n") > at_once) | (F.col("bytes") > BLOCK_BYTES)
    links = compared(rest, buckets.where(~large), tried, texts, at_least)
    if not buckets.where(large).isEmpty():
        links = links.unionByName(compared_in_blocks(rest, buckets.where(large), nodes, texts, at_least, block))
    label = joined(label, links)
    released(docs.sparkSession)
    # rows by the class of their text
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("same")).groupBy("id", "same").agg(F.count("*").alias("copies"))
    told = relabel(keyed.where("same is not null").join(nodes.select("same", F.col("node").alias("label")), "same"), "label", label)
    named = told.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "same")).alias("head"))
    out = told.join(named, "label").select("id", "same", "copies", F.col("head.id").alias("class_id"), F.col("head.same").alias("class_same"))
    alone = keyed.where("same is null").select("id", "same", "copies", F.col("id").alias("class_id"), F.col("same").alias("class_same"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, at_least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns kept: that of the smallest id.  Rows of equal (id, text) are one."""
    found = near_duplicates(docs, id_col, text_col, at_least=at_least)
    head = F.col(id_col).eqNullSafe(F.col("class_id")) & F.col("same").eqNullSafe(F.col("class_same"))
    kept = settle(found.where(head).select(F.col(id_col).alias("__id"), F.col("same").alias("__same"), "copies"))
    marked = docs.withColumn("__of", F.sha2(F.col(text_col).cast("binary"), 256))
    among = lambda some: marked.join(some.select("__id", "__same"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col("__of").eqNullSafe(F.col("__same")), "left_semi")
    return among(kept.where("copies = 1")).unionByName(among(small(kept.where("copies > 1"))).dropDuplicates([id_col, "__of"])).drop("__of")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, class_id``: every document with the smallest id of its class of near and exact copies."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
