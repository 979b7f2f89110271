"""Near duplicates by weighted MinHash of word shingles (operator 10).

A text is a bag of shingles of FIVE words. For its signature every shingle runs a Poisson process over its weight axis,
cut into strips [0,1), [1,2), [2,4), [4,8) ...: the process of a strip depends only on shingle and strip, its points have
a time, a height and a register, and a point counts if its height lies below the shingle's count. A register keeps the
earliest point that counts. Two texts agree in a register with the probability of their weighted Jaccard similarity, and
a shingle costs a number of processes logarithmic in its count. Times are followed only as far as registers need them.

Registers are banded. Texts that share a band are candidates; instead of all pairs of a bucket, a member is compared,
exactly and on the bags, with the bucket's centre (the member with the largest buckets in all) and with the members beside
it in the order of the following bands, which agree in more registers than others. Connected texts form classes. Where a
bucket still has members in different classes, all pairs across classes are then compared: those of small buckets as rows;
in larger ones the members outside the largest class and all members are dealt to blocks by their hash, and a task compares
two blocks by a product of their matrices of shingle occurrences. So texts of the similarity that share a bucket always end
in one class.

With 32 bands of 4 registers, a pair at similarity 0.8 shares no band with probability 5e-8.

Equal texts are one class from the start. Null and empty texts and texts without a word are alone. Texts of one to four
words have one shingle, all of their words. ASCII case does not count. Repeated rows are copies.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import texts, with_columns, written

FIVE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Split buckets of at most SMALL texts are compared as rows of pairs, larger ones by blocks of about BLOCK texts and BLOCK_BYTES at most; BESIDE neighbours are tried first.
SMALL, BESIDE = 24, 3
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Shingle occurrences in one product of two blocks.
WIDE = 4096
G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times_g(k: int) -> np.uint64:
    return np.uint64(int(G) * k & (1 << 64) - 1)


def bags(rows: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text, as sorted 64-bit hashes, and how often it has them."""
    import xxhash

    number: dict[bytes, int] = {}
    places, sizes = [], []
    for text in rows:
        words = text.lower().split()
        sizes.append(len(words))
        places += [number.setdefault(w, len(number)) for w in words]
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], dtype=np.uint64)[np.array(places, dtype=np.int64)]

    def chained(of: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(max(0, len(of) - n + 1), dtype=np.uint64)
        for j in range(n):
            h = mix(h * G + of[j : j + len(h)])
        return h

    shingles, at, out = chained(codes, FIVE), 0, []
    for n in sizes:
        out.append(np.unique(shingles[at : at + n - FIVE + 1] if n >= FIVE else chained(codes[at : at + n], n) if n else codes[:0], return_counts=True))
        at += n
    return out


def signatures(of: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each bag that isn't empty; the value of a register names its earliest point."""
    sizes = np.array([len(h) for h, _ in of], dtype=np.int64)
    weights = np.array([max(1, c.sum()) for _, c in of], dtype=np.float64)
    limits = registers / weights * (np.log(registers) + 3)
    best = np.full(len(of) * registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    shingle, count = (np.concatenate([x[i] for x in of]) if of else np.zeros(0, np.uint64) for i in (0, 1))
    owner = np.repeat(np.arange(len(of)), sizes)
    todo = np.flatnonzero(sizes > 0)
    while len(todo):  # a bag with a register left empty runs again, with twice the time
        chosen = np.isin(owner, todo)
        low = 0
        while True:
            high = max(1, 2 * low)
            at = np.flatnonzero(chosen & (count > low))
            if not len(at):
                break
            who, width = owner[at], float(high - low)
            source = mix(shingle[at] + times_g(low + 1))
            time, step, whole, top = np.zeros(len(at)), 0, count[at] >= high, (count[at] - low) / width
            until = limits[who]
            while len(source):
                step += 1
                x = mix(source + times_g(step))
                time = time - np.log(((x >> np.uint64(31)).astype(np.float64) + 1) / 2.0**33) / width
                stay = time <= until
                if not stay.all():
                    source, time, whole, top, until, who, x = (v[stay] for v in (source, time, whole, top, until, who, x))
                ok = whole | (((x >> np.uint64(7)) & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24 < top)
                value = (time[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(x[ok]) >> np.uint64(32))
                np.minimum.at(best, who[ok] * registers + (x[ok] % np.uint64(registers)).astype(np.int64), value)
            low = high
        full = (best.reshape(len(of), registers) != np.iinfo(np.uint64).max).all(axis=1)
        todo = todo[~full[todo]]
        limits[todo] *= 2
    return best.reshape(len(of), registers)


def band_keys(rows: list[bytes]) -> list[list[int]]:
    """The hashed bands of each text; none for a text without words."""
    of = bags(rows)
    out: list[list[int]] = []
    for at in range(0, len(of), 1000):
        part = of[at : at + 1000]
        rounds = signatures(part).reshape(len(part), BANDS, ROWS)
        keys = np.zeros((len(part), BANDS), dtype=np.uint64)
        for j in range(ROWS):
            keys = mix(keys * G + rounds[:, :, j])
        out += [k.tolist() if len(b[0]) else [] for k, b in zip(keys.view(np.int64), part)]
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def verified(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b), those whose texts reach the similarity."""
    two = pairs.join(distinct.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(distinct.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def compare(batch: pa.RecordBatch, cache: OrderedDict = OrderedDict()) -> dict[str, list]:  # noqa: B008  one for each worker
        out = []
        for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "ta"), texts(batch, "tb")):
            for k, t in ((a, ta), (b, tb)):
                if k not in cache:
                    cache[k] = bags([t])[0]
                cache.move_to_end(k)
            out.append(overlap(cache[a], cache[b]))
            while len(cache) > 500:
                cache.popitem(last=False)
        return {"similarity": out}

    return with_columns(two, compare, {"similarity": "double"}, ["a", "b"]).filter(F.col("similarity") >= similarity)


def occurrences(of: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every occurrence of a shingle, the second of a shingle told from the first: sets whose overlap is that of the bags."""
    owner = np.repeat(np.arange(len(of)), [len(h) for h, _ in of])
    shingle, count = (np.concatenate([x[i] for x in of]) if of else np.zeros(0, np.int64) for i in (0, 1))
    count = count.astype(np.int64)
    owner, shingle = np.repeat(owner, count), np.repeat(shingle.astype(np.uint64), count)
    nth = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    return owner, np.where(nth == 0, shingle, mix(shingle + nth * G))


def overlaps(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of each bag of a with each of b."""
    (own_a, in_a), (own_b, in_b) = occurrences(a), occurrences(b)
    common = np.intersect1d(in_a, in_b)
    both = np.zeros((len(a), len(b)), dtype=np.float32)

    def placed(owner: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(common, has), max(0, len(common) - 1))
        ok = common[at] == has if len(common) else np.zeros(len(has), bool)
        order = np.argsort(at[ok], kind="stable")
        return owner[ok][order], at[ok][order]

    (own_a, at_a), (own_b, at_b) = placed(own_a, in_a), placed(own_b, in_b)
    for low in range(0, len(common), WIDE):
        sides = []
        for owner, at, n in ((own_a, at_a, len(a)), (own_b, at_b, len(b))):
            i, j = np.searchsorted(at, [low, low + WIDE])
            side = np.zeros((n, min(WIDE, len(common) - low)), dtype=np.float32)
            side[owner[i:j], at[i:j] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    sums = np.array([c.sum() for _, c in a], dtype=np.float64)[:, None] + np.array([c.sum() for _, c in b], dtype=np.float64)[None, :]
    return both / np.maximum(1, sums - both)


def across(left: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes with a link between their members in a bucket. left: band, hash, key, class, bytes, largest (of the bucket's classes).

    Members outside the largest class meet all members, a block of the ones and a block of the others in a task."""
    bucket = ["band", "hash"]
    outer = F.col("class") != F.col("largest")
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    sizes = left.groupBy(*bucket).agg(parts(F.count(F.lit(1)), F.sum("bytes")).alias("all_parts"), parts(F.count_if(outer), F.sum(F.when(outer, F.col("bytes")))).alias("outer_parts"))
    rows = left.join(sizes, bucket).join(of.select("key", "text"), "key")
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(7)), n).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    ones = rows.filter(outer).select(*bucket, "class", "text", F.lit(0).alias("side"), dealt(F.col("outer_parts")).alias("i"), F.explode(each("all_parts")).alias("j"))
    others = rows.select(*bucket, "class", "text", F.lit(1).alias("side"), F.explode(each("outer_parts")).alias("i"), dealt(F.col("all_parts")).alias("j"))

    def compare(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        found, number = block.column("class").to_pylist(), {}
        cls = np.array([number.setdefault(c, len(number)) for c in found], dtype=np.int64)
        bag = bags([x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()])
        one, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = overlaps([bag[k] for k in one], [bag[k] for k in other]) >= similarity
        x, y = np.nonzero(near & (cls[one][:, None] != cls[other][None, :]))
        names = list(number)
        links = np.unique(np.stack([cls[one][x], cls[other][y]], axis=1), axis=0).tolist()
        return pa.table({"a": pa.array([names[i] for i, _ in links], pa.binary()), "b": pa.array([names[j] for _, j in links], pa.binary())})

    return ones.unionByName(others).groupBy(*bucket, "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that links reach from it) of all nodes of links (a, b), by alternating large and small stars."""
    least = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links", few=True)
    before = None
    while True:
        # Large star: a node's larger neighbours go to its least neighbour.
        both = least.unionByName(least.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        least = written(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars", instead_of=least, few=True)
        now = tuple(least.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return least.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(key, class) of every distinct text with words that is linked to another, and the expression that gives a row's key.

    key: 128 bits of the text's hash. class: the least key of the texts that links connect."""
    key = text_key(text)
    distinct = written(docs.filter(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text")), "texts")
    banded = written(with_columns(distinct, lambda b: {"bands": band_keys(rows := texts(b, "text")), "bytes": [len(x) for x in rows]}, {"bands": "array<long>", "bytes": "long"}, ["key"]), "bands")
    bucket = ["band", "hash"]
    member = banded.select("key", F.posexplode("bands").alias("band", "hash"))
    counts = member.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    member = written(member.join(counts, bucket), "buckets")
    degree = member.groupBy("key").agg(F.sum("n").alias("degree"))
    of = written(distinct.join(degree.select("key"), "key", "left_semi"), "candidates")
    # In a bucket, texts that agree in the following bands too stand side by side.
    member = written(member.join(degree, "key").join(banded, "key").select(*bucket, "key", "n", "degree", "bytes", *[F.element_at("bands", ((F.col("band") + j) % BANDS + 1).cast("int")).alias(f"next{j}") for j in (1, 2, 3)]), "ordered")
    side = Window.partitionBy(*bucket).orderBy("next1", "next2", "next3", "key")
    centre = F.max(F.struct("degree", "key")).over(Window.partitionBy(*bucket))["key"]
    beside = F.array_compact(F.array(centre, *[F.lag("key", j).over(side) for j in range(1, BESIDE + 1)]))
    ordered = lambda df: df.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = written(ordered(member.select(F.col("key").alias("a"), beside.alias("beside")).select("a", F.explode("beside").alias("b"))), "tried")
    links = written(verified(tried, of, similarity), "verified", few=True)
    # What buckets with several classes leave: all pairs across classes, of small ones as rows and of others by blocks.
    roots = components(links)
    rooted = written(member.select(*bucket, "key", "n", "bytes").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("root", "key")).drop("root"), "rooted")
    sizes = rooted.groupBy(*bucket, "class").agg(F.count(F.lit(1)).alias("size"))
    split = sizes.groupBy(*bucket).agg(F.max(F.struct("size", "class")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(*bucket, F.col("top.class").alias("largest"))
    left = written(rooted.join(split, bucket), "left", few=True)
    few = left.filter(F.col("n") <= SMALL)
    other = few.select(*bucket, F.col("key").alias("b"), F.col("class").alias("class_b"))
    new = few.join(other, bucket).filter("key < b and class != class_b").select(F.col("key").alias("a"), "b")
    new = ordered(new).join(tried, ["a", "b"], "left_anti")
    wide = across(left.filter(F.col("n") > SMALL), of, similarity)
    roots = components(links.select("a", "b").unionByName(verified(new, of, similarity).select("a", "b")).unionByName(wide))
    return roots.select(F.col("node").alias("key"), F.col("root").alias("class")).unionByName(roots.select(F.col("root").alias("key"), F.col("root").alias("class")).distinct()), key


def text_key(text: str):
    return F.unhex(F.md5(F.col(text)))


def grouped(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size and copies (rows with the same text) of every row of docs."""
    linked, key = classes(docs, text, similarity)
    worded = F.col(text).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select("doc_id", F.when(worded, key).alias("key"))
    ids = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    ids = written(ids.join(linked, "key", "left").withColumn("class", F.coalesce("class", "key")), "ids")
    by_class = ids.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    ids = ids.join(by_class, "class").select("key", "class_id", "class_size", "copies")
    return rows.join(ids, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def filtered(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: of its texts, a row with the least doc_id. Rows without a word all stay."""
    linked, key = classes(docs, text, similarity)
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.filter(worded).withColumn("__near_key", key)
    ids = rows.groupBy("__near_key").agg(F.min("doc_id").alias("least")).withColumnRenamed("__near_key", "key").join(linked, "key", "left")
    stay = ids.groupBy(F.coalesce("class", "key").alias("c")).agg(F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("one"))
    stay = stay.select(F.col("one.least").alias("__near_id"), F.col("one.key").alias("__near_of"))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_key") == F.col("__near_of"))).dropDuplicates(["doc_id", "__near_key"])
    return kept.select(*docs.columns).unionByName(docs.filter(~worded))
