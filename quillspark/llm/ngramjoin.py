"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct shingles of WIDTH words, hashed; two documents
link when 100 * intersection >= PERCENT * union. If x and y link, at most
t = n - ceil(PERCENT n / 100) of x's n shingles are missing in y.

1. One pass over the texts deals the shingles of each block of documents to buckets
   by hash. A bucket counts the documents of each shingle (frequency) and returns
   to each block what occurs in two documents or more.
2. Shingles of frequency 1 count as missing; a document with more than t of them
   links with nothing. The rest are ordered by frequency, then hash: one order for
   all. Rare shingles (frequency up to RARE) are indexed alone, frequent ones as
   pairs within one of several sub-classes. The prefix is extended, in that order,
   until  singles + sum over sub-classes of (members - 1) > t - missing,  so that
   two linking sets share a single or a pair, whichever t are missing. Signatures
   carry a band of set sizes; a set is indexed in each band where a partner could
   be the larger one. (The bound can be reached but for sets of one shingle, which
   link with equal sets only.)
   Each signature knows its reach: what two sets can share at most if it is the first
   in that order which they have in common.
3. Equal sets become one class, which has a number. Every class is
   verified against the candidate that shares most signatures with it; links form
   components. Then, where a signature's classes lie in different components, the
   components' leaders are compared, unless their sizes and reaches rule out a
   link. Where the triangle inequality of the Jaccard
   distance doesn't rule out a link of two components, all their members are
   compared, in cells of bounded size. Pairs within a component need no check, so
   a large group of copies costs its size, not its square, and no link between
   components is lost.

component_id needs no more; the links of a document are not counted.

Bounds: a block holds BLOCK_CHARS of text, or one document; hashes keep 48 bits, so
two sets of 1,000 shingles give another count with a probability under 1e-8. A
shingle of more than FEW documents of a block goes to its bucket once for the block,
so a passage that all documents share weighs a few entries a block. The number of
buckets follows the size of the input.

Defined results: null and empty texts, and those of white space alone, have an
empty set and link with nothing; fewer than WIDTH words are one shingle; rows that
repeat an id are documents of their own: each has the component of its text, named by
the smallest id in it; a null id stays null and names no component; other columns
are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import attach, table
from .components import components
from .shared import borrowed, scratch, slices, stage, two

WIDTH, PERCENT = 5, 75
RARE = 32
BLOCK_CHARS, FEW = 3_000_000, 8
TOP = 65_535  # frequencies above it count as equal: any order that all documents share will do
BUCKET_CHARS = 12_000_000
EPS = 1e-12
_words: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    made = xxhash.xxh3_64_intdigest(word)
    if len(word) < 48:
        if len(_words) > 100_000:
            _words.clear()
        _words[word] = made
    return made


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    get = _words.get
    one = np.fromiter([get(w) or word_hash(w) for w in words], np.uint64, len(words))
    width = min(width, len(one))
    n = len(one) - width + 1
    made = np.full(n, width, np.uint64)
    for i in range(width):
        made *= np.uint64(0x9E3779B97F4A7C15)
        made ^= one[i : i + n]
        made ^= made >> np.uint64(29)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    made ^= made >> np.uint64(32)
    return np.unique(made)


def missing(n: int) -> int:
    """How many of n shingles a partner may lack."""
    return n - -(-PERCENT * n // 100)


DEALT = "bucket int, block long, docs binary, owner binary, hashes binary, weights binary"
FULL = np.uint64(16)  # of a 64-bit hash the upper 48 bits are kept


def splits(chars: int) -> int:
    """How often each of the 256 buckets is split, as a power of two."""
    return max(0, (chars // (256 * BUCKET_CHARS)).bit_length())


def packed(hashes: np.ndarray) -> bytes:
    """Five bytes of each 48-bit hash; the bucket has the sixth."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(five: bytes, bucket: int) -> np.ndarray:
    raw = np.frombuffer(five, np.uint8).reshape(-1, 5)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :5] = raw
    return whole.view(np.uint64).ravel() | np.uint64(bucket << 40)


def dealt(texts: DataFrame, split: int) -> DataFrame:
    """A row for each block of documents and bucket, and one (bucket -1) for the block itself."""
    names = DEALT.replace(",", "").split()[::2]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    low = np.uint64((1 << split) - 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int | None, int, bytes]] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) for s in held])
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            every = np.concatenate(held) >> FULL
            # partition and number tell blocks of equal content apart
            block = xxhash.xxh3_64_intdigest(b"".join(d[2] for d in docs) + repr((partition, number, [d[0] for d in docs])).encode()) >> 1
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(every)))
            heavy = np.repeat(times > FEW, times)
            kept = pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "n": pa.array([d[1] for d in docs], pa.int64()), "digest": pa.array([d[2] for d in docs], pa.binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as w:
                w.write_table(kept)
            rows = [(-1, block, sink.getvalue().to_pybytes(), owner[heavy].astype("<u2").tobytes(), every[heavy].tobytes(), None)]
            # a heavy shingle goes once, for the whole block, under an owner past the last
            lone, top = first[times > FEW], times[times > FEW].astype("<u4")
            light = ~heavy
            sent = np.concatenate([every[light], every[lone]])
            whose = np.concatenate([owner[light], np.full(len(lone), len(held), np.uint32)])
            weight = np.concatenate([np.ones(int(light.sum()), "<u4"), top])
            bucket = (sent >> np.uint64(40)) << np.uint64(split) | (sent & low)
            order = np.argsort(bucket, kind="stable")
            sent, whose, weight, bucket = sent[order], whose[order], weight[order], bucket[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, z in zip(starts, [*starts[1:], len(bucket)]):
                w = weight[a:z]
                rows.append((int(bucket[a]), block, None, whose[a:z].astype("<u2").tobytes(), packed(sent[a:z]), w.tobytes() if (w > 1).any() else None))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), kinds)], names)

        chars = number = 0
        partition = TaskContext.get().partitionId()
        with borrowed(_words):
            for b in slices(batches, 128):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    made = shingles(text)
                    docs.append((doc, len(made), xxhash.xxh3_128_digest(made.tobytes())))
                    held.append(made)
                    chars += len(text)
                    if chars >= BLOCK_CHARS or len(held) >= 60_000:
                        yield from flush()
                        docs, held, chars, number = [], [], 0, number + 1
            if held:
                yield from flush()

    return texts.mapInArrow(kernel, DEALT)


def counted(blocks: DataFrame, split: int) -> DataFrame:
    """For each block and bucket what occurs in two documents or more, with its frequency."""
    out = "bucket int, block long, docs binary, owner binary, hashes binary, often binary"
    names = out.replace(",", "").split()[::2]
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)

    def kernel(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        block = table["block"].to_pylist()
        if bucket < 0:
            return table.select(names[:-1]).append_column("often", pa.nulls(len(block), pa.binary()))
        hashes = [unpacked(h, bucket >> split) for h in table["hashes"].to_pylist()]
        weights = [np.ones(len(h), np.int64) if w is None else np.frombuffer(w, "<u4").astype(np.int64) for w, h in zip(table["weights"].to_pylist(), hashes)]
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        often = np.bincount(inverse, np.concatenate(weights))[inverse]
        rows, at = [], 0
        for name, own, mine in zip(block, table["owner"].to_pylist(), hashes):
            times = often[at : at + len(mine)]
            at += len(mine)
            shared = times > 1
            if shared.any():
                rows.append((bucket, name, None, np.frombuffer(own, "<u2")[shared].tobytes(), packed(mine[shared]), np.minimum(times[shared], TOP).astype("<u2").tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    salted = blocks.withColumn("part", F.when(F.col("bucket") < 0, F.pmod("block", F.lit(1024))).otherwise(F.lit(0)))
    return salted.groupBy("bucket", "part").applyInArrow(kernel_of(kernel), out)


def kernel_of(f):
    """applyInArrow looks at a function's signature; a plain one-argument function it must be."""
    def one(table: pa.Table) -> pa.Table:
        return f(table)
    return one


def bands(n: int) -> list[int]:
    """Bands of set sizes (powers of two) in which a set of n can meet a partner not smaller than itself, and its own."""
    top = n * 100 // PERCENT
    return list(range(n.bit_length(), top.bit_length() + 1))


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    made = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    made = (made ^ (made >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return made ^ (made >> np.uint64(32))


def signatures(n: int, hashes: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of a set of n shingles: hashes are those that occur elsewhere too, in the order of all, the rare ones first.

    With each goes the reach: the most that the set can share with a partner whose first common signature this is. Of a
    single, nothing before it is common; of a pair, at most one shingle of each other sub-class before its first member."""
    m = len(hashes)
    room = missing(n) - (n - m)
    made, reach = [], []
    for band in bands(n):
        tag = np.uint64(band)
        singles = room + 1 if rare > room else rare
        made.append(mixed(hashes[:singles], tag))
        reach.append(m - np.arange(singles))
        if rare > room:
            continue
        short = room + 1 - rare
        rest = hashes[rare:]
        classes = max(1, (1 << band) // 32)
        own = (mixed(rest, np.uint64(0x51)) % np.uint64(classes)).astype(np.int64)
        # each member of a sub-class but its first adds one
        again = np.ones(len(rest), np.int64)
        again[np.unique(own, return_index=True)[1]] = 0
        upto = int(np.searchsorted(np.cumsum(again), short)) + 1
        rest, own = rest[:upto], own[:upto]
        by = np.argsort(own, kind="stable")
        rest, own = rest[by], own[by]
        left = m - rare - by + np.minimum(classes - 1, by)
        for d in range(1, int(np.bincount(own).max()) if len(own) else 0):
            same = own[:-d] == own[d:]
            made.append(mixed(np.minimum(rest[:-d], rest[d:])[same], np.maximum(rest[:-d], rest[d:])[same] + tag))
            reach.append(left[:-d][same])
    made, at = np.unique(np.concatenate(made), return_index=True)
    return made, np.concatenate(reach)[at]


DOCS = "doc_id long, n long, digest binary, rare int, hashes binary"


def indexed(parts: DataFrame, split: int) -> DataFrame:
    """A row for each document; where it may link, what others hold too (in the order of all) and how much of it is rare."""
    names = DOCS.replace(",", "").split()[::2]

    def kernel(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table["docs"]))
        if own.num_rows != 1:
            raise ValueError(f"{own.num_rows} blocks of one name")
        more = table.filter(pa.compute.is_null(table["docs"]))
        kept = pa.ipc.open_stream(own["docs"][0].as_py()).read_all()
        n, size = kept["n"].to_numpy(), kept.num_rows
        owner, often = (np.frombuffer(b"".join(more[c].to_pylist()), "<u2") for c in ("owner", "often"))
        hashes = np.concatenate([np.zeros(0, np.uint64)] + [unpacked(h.as_py(), b.as_py() >> split) for b, h in zip(more["bucket"], more["hashes"])])
        del table, more
        alone = owner == size
        heavy, times = hashes[alone], often[alone]
        order = np.argsort(heavy)
        heavy, times = heavy[order], times[order]
        mine = np.frombuffer(own["owner"][0].as_py(), "<u2"), np.frombuffer(own["hashes"][0].as_py(), np.uint64)
        owner = np.concatenate([owner[~alone], mine[0]])
        hashes = np.concatenate([hashes[~alone], mine[1]])
        often = np.concatenate([often[~alone], times[np.searchsorted(heavy, mine[1])] if len(mine[1]) else times[:0]])
        order = np.lexsort((hashes, often, owner))
        owner, hashes, often = owner[order], hashes[order], often[order]
        edges = np.searchsorted(owner, np.arange(size + 1))
        held = np.diff(edges)
        able = (n >= 2) & (n - held <= n + -PERCENT * n // 100)
        rare = np.diff(np.concatenate([[0], np.cumsum(often <= RARE)])[edges])
        sets = [shut(hashes[edges[i] : edges[i + 1]]) if able[i] else None for i in range(size)]
        return pa.table([kept["doc_id"], kept["n"], kept["digest"], pa.array(rare, pa.int32()), pa.array(sets, pa.binary())], names=names)

    return parts.groupBy("block").applyInArrow(kernel_of(kernel), DOCS)


def shut(hashes: np.ndarray) -> bytes:
    """The six bytes of each 48-bit hash."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def opened(six: bytes) -> np.ndarray:
    raw = np.frombuffer(six, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(raw), 8), np.uint8)
    whole[:, :6] = raw
    return whole.view(np.uint64).ravel()


def posted(live: DataFrame) -> DataFrame:
    """(sig, doc, reach): a row for each signature of a class."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                signs = [signatures(n, opened(h), rare) for n, rare, h in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))]
                docs = np.repeat(part.column(0).to_numpy(), [len(x) for x, _ in signs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in signs]).view(np.int64)), pa.array(docs), pa.array(np.concatenate([r for _, r in signs]), pa.int32())], ["sig", "doc", "reach"])

    return live.select("doc", "n", "rare", "hashes").mapInArrow(kernel, "sig long, doc long, reach int")


STARS, EARLIER = 64, 32


def verified(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """(a, b, link, distance) of pairs (a, b).

    The pairs of one b meet in up to STARS parts, and b's set is sent once to each, not once with every partner."""
    asked = stage(pairs.select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.lit(STARS)).alias("part")), "pairs")
    spokes = asked.select("hub", "part", F.col("a").alias("doc"), F.lit(1).alias("spoke"))
    hubs = asked.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("doc"), F.lit(0).alias("spoke"))
    rows = spokes.unionByName(hubs).join(live.select("doc", "n", "hashes"), "doc").select("hub", "part", "spoke", "doc", "n", "hashes")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, size, held = 0, 0, np.zeros(0, np.uint64)
        for b in batches:
            made = []
            for i, (spoke, doc, n) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))):
                mine = opened(b.column(5)[i].as_py())
                if not spoke:
                    hub, size, held = doc, n, np.sort(mine)
                    continue
                same = int((held[np.minimum(np.searchsorted(held, mine), len(held) - 1)] == mine).sum())
                made.append((doc, hub, 100 * same >= PERCENT * (n + size - same), 1 - same / (n + size - same)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["a", "b", "link", "distance"])

    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "spoke")
    return dealt.mapInArrow(kernel, "a long, b long, link boolean, distance double")


def linked(live: DataFrame) -> DataFrame:
    """(a, b): links that connect what all links together connect."""
    # written first, so that the join has plain exchanges on both sides and a hot signature's rows are split
    ends = stage(posted(live).groupBy("sig").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last").select("sig", "lead"), "signatures")
    useful = stage(posted(live).join(ends, "sig"), "postings")
    if useful.isEmpty():
        return live.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    shared = useful.where("doc <> lead").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("doc").agg(F.max(F.struct(F.col("n"), (-F.col("lead")).alias("m")))["m"].alias("m"))
    first = stage(verified(best.select(F.col("doc").alias("a"), (-F.col("m")).alias("b")), live), "first")
    links = first.where("link").select("a", "b")
    group = stage(components(links), "group")
    # again, for documents whose best candidate didn't link: the one of another component with most signatures in common
    placed = useful.join(group.withColumnRenamed("id", "doc"), "doc", "left")
    crowds = stage(placed.where("component IS NOT NULL").groupBy("sig").agg(F.min("doc").alias("first")), "crowds")
    votes = placed.where("component IS NULL").join(crowds, "sig").groupBy("doc", "first").agg(F.count(F.lit(1)).alias("n"))
    second = votes.groupBy("doc").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("m")))["m"].alias("m")).select(F.col("doc").alias("a"), (-F.col("m")).alias("b"))
    more = stage(verified(second.join(first.select("a", "b"), ["a", "b"], "left_anti"), live).where("link").select("a", "b"), "more")
    links = links.union(more)
    group = stage(components(links), "group")

    links, group, heads, order = gathered(useful, live, links, group)
    heads = stage(heads.join(order, "sig"), "ordered")
    # a pair is made at the first signature at which it fits, in an order of all signatures: each row knows EARLIER crowded ones that
    # come before it and fit wherever it does; if two components have one of these in common, they meet there
    most = Window.partitionBy("comp").orderBy(F.desc("crowd"), "sig")
    known = heads.withColumn("place", F.row_number().over(most)).where(F.col("place") <= EARLIER)
    known = stage(known.groupBy("comp").agg(F.collect_list(F.struct("sig", "top", "least", "most", "held")).alias("known")), "known")
    ahead = lambda e: (e["top"] > F.col("top")) | ((e["top"] == F.col("top")) & (e["sig"] < F.col("sig")))
    over = lambda e: (e["least"] <= F.col("least")) & (e["most"] >= F.col("most")) & (e["held"] >= F.col("held"))
    before = F.transform(F.filter("known", lambda e: ahead(e) & over(e)), lambda e: e["sig"])
    heads = stage(heads.join(known, "comp").select("sig", "comp", "least", "most", "held", before.alias("before")), "chained")
    left, right = (heads.select("sig", F.col("comp").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("least", "most", "held", "before"))) for c in "ab")
    fits = (F.col("a") < F.col("b")) & (100 * F.col("a_most") >= PERCENT * F.col("b_least")) & (100 * F.col("b_most") >= PERCENT * F.col("a_least"))
    fits &= (100 + PERCENT) * F.least("a_held", "b_held") >= PERCENT * (F.col("a_least") + F.col("b_least"))
    across = stage(left.join(right, "sig").where(fits & ~F.arrays_overlap("a_before", "b_before")).select("a", "b").distinct(), "across")
    # the radius of each component that takes part, around its leader
    named = across.select(F.col("a").alias("component")).union(across.select(F.col("b").alias("component"))).distinct()
    spokes = group.join(named, "component").where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    wide = stage(verified(spokes, live).groupBy(F.col("b").alias("comp")).agg(F.max("distance").alias("r")), "radii")
    met = stage(verified(across, live), "met")
    limit = 1 - PERCENT / 100 + EPS
    reach = met.join(wide.select(F.col("comp").alias("a"), F.col("r").alias("ra")), "a", "left").join(wide.select(F.col("comp").alias("b"), F.col("r").alias("rb")), "b", "left")
    open_ = reach.where(~F.col("link") & (F.col("ra").isNotNull() | F.col("rb").isNotNull()))
    open_ = open_.where(F.col("distance") - F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0)) <= limit).select("a", "b", "distance")
    last = crossed(open_, group, live)
    return links.union(met.where("link").select("a", "b")).union(last)


ROUNDS, TRIES, CROWD = 6, 8, 16


def gathered(useful: DataFrame, live: DataFrame, links: DataFrame, group: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """More links; the components of all, (sig, comp, least, most, held) where signatures lie in several and (sig, crowd, top).

    While the signatures' components would make more than CROWD pairs for each of these rows, every document is verified against few
    others of different components: each round a hash draws a lead for each signature, and those that share most with a document
    count. Where many near copies differ as much from each other as from their first, some of these link, and the crowd becomes
    one component at a cost in proportion to its size. What does not link in this way is left to the exact comparison."""
    turn, last = 0, False
    while True:
        facts = live.select("doc", "n").join(group.withColumnRenamed("id", "doc"), "doc", "left")
        joined = useful.join(facts, "doc").select("sig", "doc", "n", "reach", F.coalesce("component", "doc").alias("comp"))
        mixed = stage(joined.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("sig"), "mixed")
        active = stage(joined.join(mixed, "sig"), "active")
        # a link passes this test at its first common signature, so components that pass it at none have no link
        heads = stage(active.groupBy("sig", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("held")), "heads")
        order = stage(heads.groupBy("sig").agg(F.count(F.lit(1)).alias("crowd"), F.max("held").alias("top")), "order")
        rows, pairs = order.agg(F.coalesce(F.sum("crowd"), F.lit(0)), F.coalesce(F.sum(F.expr("crowd * (crowd - 1) / 2")), F.lit(0.0))).first()
        if last or pairs <= CROWD * rows:
            return links, group, heads, order
        drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "doc").alias("r"), F.col("doc").alias("lead"), F.col("comp").alias("there")))
        leads = stage(active.groupBy("sig").agg(drawn.alias("m")).select("sig", "m.lead", "m.there"), "leads")
        votes = active.join(leads, "sig").where("comp <> there").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("n"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("n", "lead")), asc=False), 1, TRIES)  # a lead for each signature at most
        tried = votes.groupBy("doc").agg(best.alias("best")).select(F.col("doc").alias("a"), F.explode("best.lead").alias("b"))
        met = stage(verified(tried, live), "tried")
        found = met.where("link").select("a", "b")
        many, linking = met.agg(F.count(F.lit(1)), F.count(F.when(F.col("link"), 1))).first()
        if not linking:
            return links, group, heads, order
        links = links.union(found)
        group = stage(components(links), "group")
        turn += 1
        last = turn == ROUNDS or 50 * linking < many


CHUNK = 256


def crossed(pairs: DataFrame, group: DataFrame, live: DataFrame) -> DataFrame:
    """(a, b): a link between two components (a, b, distance of their leaders), where there is one.

    The members of the larger one and those of the smaller meet in cells of CHUNK by CHUNK documents, so a set is sent
    once for each cell rather than for each pair, and a cell returns one link for each document of the smaller side."""
    named = pairs.select(F.col("a").alias("comp")).union(pairs.select(F.col("b").alias("comp"))).distinct()
    inside = named.join(group.select("id", F.col("component").alias("comp")), "comp", "left").select("comp", F.coalesce("id", "comp").alias("doc")).distinct()
    sizes = inside.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.join(sizes.select(F.col("comp").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("comp").alias("b"), F.col("size").alias("sb")), "b")
    first = F.col("sa") >= F.col("sb")
    turned = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("small"), "distance", F.greatest("sa", "sb").alias("n"), F.least("sa", "sb").alias("m"))
    grid = turned.groupBy("big").agg(F.ceil(F.max("n") / CHUNK).cast("long").alias("parts"), F.ceil(F.sum("m") / CHUNK).cast("long").alias("others"))
    here = lambda by: F.pmod(F.xxhash64("doc"), F.col(by))
    every = lambda by: F.explode(F.sequence(F.lit(0).cast("long"), F.col(by) - 1))
    asked = turned.select("big", "small").join(inside.withColumnRenamed("comp", "small"), "small").join(grid, "big")
    asked = asked.withColumn("other", here("others")).withColumn("part", every("parts")).select("big", "part", "other", "doc", "small").distinct()
    there = grid.join(inside.withColumnRenamed("comp", "big"), "big").withColumn("part", here("parts")).withColumn("other", every("others"))
    there = there.select("big", "part", "other", "doc", F.lit(None).cast("long").alias("small"))
    rows = asked.unionByName(there).join(live.select("doc", "n", "hashes"), "doc")

    def kernel(table: pa.Table) -> pa.Table:
        side = table["small"].is_null().to_numpy()
        docs, n = table["doc"].to_numpy(), table["n"].to_numpy()
        sets = [opened(h) for h in table["hashes"].to_pylist()]
        base = np.flatnonzero(side)
        made = []
        if len(base):
            every_ = np.concatenate([sets[i] for i in base])
            order = np.argsort(every_, kind="stable")
            ranked, owner = every_[order], np.repeat(np.arange(len(base)), [len(sets[i]) for i in base])[order]
            for i in np.flatnonzero(~side):
                lo, hi = np.searchsorted(ranked, sets[i], "left"), np.searchsorted(ranked, sets[i], "right")
                hit = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
                same = np.bincount(owner[hit], minlength=len(base))
                linked = np.flatnonzero(100 * same >= PERCENT * (n[base] + n[i] - same))
                if len(linked):
                    made.append((int(docs[i]), int(docs[base[linked[0]]])))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*made) if made else ([], []))], names=["a", "b"])

    return rows.groupBy("big", "part", "other").applyInArrow(kernel_of(kernel), "a long, b long")


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of df."""
    texts = two(df, key, text)
    split = splits(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
    every = stage(indexed(counted(dealt(texts, split), split), split), "sets")
    # a class has a number of its own, written once: an id with two texts is in two classes
    classes = every.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    classes = stage(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    holders = every.where("hashes IS NOT NULL").select("digest", F.col("doc_id").alias("first"), "n", "rare", "hashes")
    with scratch() as keep:
        live = stage(holders.join(classes, ["digest", "first"]).dropDuplicates(["doc", "digest"]).select("doc", "n", "rare", "hashes"), "live")
        found = components(linked(live)).withColumnRenamed("id", "doc")
        # components are named by the smallest id of their classes; only classes that have links take part
        inside = stage(found.join(classes, "doc").select("digest", "first", "component"), "inside")
        names = stage(inside.groupBy("component").agg(F.min("first").alias("least")), "names")
        named = inside.join(names, "component").select("digest", "least")
        # classes get their component before they meet the rows: the join with a crowd of copies is the last and has no aggregate beside it
        placed = keep(classes.join(named, "digest", "left").select("digest", F.coalesce("least", "first").alias("component")), "placed")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    facts = every.select("doc_id", "n", "digest").join(placed, "digest", "left")
    return facts.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op4_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents."""
    attach(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngramjoin": op4_ngramjoin}
ORACLE_SQL: dict[str, str] = {}
