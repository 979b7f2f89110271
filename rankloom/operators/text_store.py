"""A stored text index: postings written once, so that a request reads its own terms' and stops early.

Layout of the folder, all Parquet:

    stats                    one row: what the index was made of, and which buckets and parts exist
    terms/bucket=B           term, df, and for each level how many postings its blocks have
    blocks/bucket=B          term, level, top, docs, weights: at most BLOCK postings, the heaviest first
    documents/part=P         doc_id, terms, weights: the postings of a document

A posting's weight is its BM25 saturation, which no query changes; a block's `top` is its greatest weight, its level is top * LEVELS as a
whole number. A term's bucket is the crc32 of its bytes.

A request knows from `terms` how deep each of its terms goes. It reads the blocks of the highest levels, HEAD postings a
term at first (more for few terms), and adds up what it sees. The k-th best sum is a bound that a document has to reach; a document that wasn't seen can have no more
than each term's heaviest unread posting. Where that is less, no other document can come in; else the request reads deeper. Documents
that might still reach the bound get their whole sums from `documents`. So results are those of a pass over the whole corpus.

Building needs two shuffles of the postings. A task sorts its own postings by term and weight, and cuts full blocks off at once;
these are dealt to any task of their bucket, so a term that all documents have is no hot key. Only what is left of a
term, less than a block a task, meets in one task, as a sorted stream.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import FORM_A, FORM_B, tokens_a, tokens_b
from rankloom.operators import index
from rankloom.operators.sizes import checkpointed

BLOCK, LEVELS = 128, 32
#: Postings that a task sorts at once, and that are merged at once of what is left of a term.
CHUNK, MERGED = 1 << 21, 1 << 20
#: Postings a term, and a request, that are read at first.
HEAD, FIRST = 1_000, 1 << 18
#: A bucket has about so many terms, a part about so many documents.
BUCKET_TERMS, PART_DOCUMENTS, MOST = 4_096, 4_096, 4_096
#: A bucket's full blocks are dealt to a task for each BUCKET_POSTINGS of them, SPREAD tasks at the most.
BUCKET_POSTINGS, SPREAD = 4 << 20, 64
#: Terms of a request up to which they are filters of the scan, and documents of which a request asks for the whole sums at once.
FILTERS, UNSURE = 64, 10_000
#: Postings that a request may bring to the driver, and rows of its answer; with more, Spark makes the sums.
DRIVER = 1 << 20
#: Queries beyond which a request that needs more than DRIVER postings is one pass over the documents' own: it would read most of them anyway.
PASS = 32
FORMS = {"a": (FORM_A, tokens_a), "b": (FORM_B, tokens_b)}


def bucket_of(term: Column, many: int) -> Column:
    return (F.crc32(term) % many).cast("int")


def write(docs: DataFrame, doc_id: str, text: str, path: str, form: str = "a") -> None:
    """Writes the index of docs to a folder that does not exist yet. form: a for bm25_a, b for bm25_b. doc_id names a row."""
    spark, kind, (shape, _) = docs.sparkSession, docs.schema[doc_id].dataType, FORMS[form]
    vocab = checkpointed(index.vocabulary(docs, text, shape))
    n, avgdl = index.corpus_numbers(vocab)
    own = vocab.filter("term is not null")
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    many_terms, mean = own.agg(F.count(F.lit(1)), F.coalesce(F.avg(raw), F.lit(0.0))).first()
    buckets, parts = (max(1, min(MOST, x)) for x in (-(-many_terms // BUCKET_TERMS), -(-n // PART_DOCUMENTS)))
    id_type = to_arrow(kind)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, weights = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                words = shape.terms(value)
                if words:
                    counts = Counter(words)
                    tf = np.array(list(counts.values()), float)
                    ids.append(i)
                    terms.append([w.decode() for w in counts])
                    weights.append(tf * (index.K1 + 1) / (tf + index.K1 * (1 - index.B + index.B * len(words) / avgdl)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())).cast(id_type), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], names=["doc_id", "terms", "weights"])

    listed_as = T.StructType([T.StructField("doc_id", kind), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    by_document = index.spread(docs.select(doc_id, text)).mapInArrow(listed, listed_as)
    dealt = by_document.withColumn("part", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)).cast("int"))
    dealt.repartition(parts, "part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").parquet(f"{path}/documents")
    total = own.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    spread = max(1, min(SPREAD, total // buckets // BUCKET_POSTINGS))
    _blocks(spark.read.schema(listed_as).parquet(f"{path}/documents"), kind, buckets, spread).write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema("term string, level int, docs array<" + kind.simpleString() + ">, bucket int").parquet(f"{path}/blocks")
    levels = blocks.groupBy("term", "level").agg(F.sum(F.size("docs")).alias("n")).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("level", "n"))).alias("levels"))
    terms = own.join(levels, "term").select("term", "df", "levels", bucket_of(F.col("term"), buckets).alias("bucket"))
    terms.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    used = [r[0] for r in blocks.select("bucket").distinct().collect()]
    row = (form, n, avgdl, mean, buckets, sorted(used), parts, kind.simpleString())
    spark.createDataFrame([row], "form string, n long, avgdl double, mean double, buckets int, used array<int>, parts int, doc_type string").coalesce(1).write.parquet(f"{path}/stats")


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _blocks(documents: DataFrame, kind: T.DataType, buckets: int, spread: int) -> DataFrame:
    """term, level, top, docs, weights and bucket: a term's postings in blocks, the heaviest first."""
    id_type = to_arrow(kind)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def cut(terms: pa.Array, code: np.ndarray, ids: pa.Array, weights: np.ndarray) -> pa.RecordBatch:
        """Blocks of postings: of each the place of its term in terms, its document and its weight."""
        order = np.lexsort((-weights, code))
        n = np.bincount(code, minlength=len(terms))
        many = -(-n // BLOCK)
        of = np.repeat(np.arange(len(terms)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        ends = np.cumsum(np.minimum(BLOCK, n[of] - nth * BLOCK))
        offsets, weights = pa.array(np.concatenate([[0], ends]), pa.int32()), weights[order]
        tops = weights[np.concatenate([[0], ends])[:-1].astype(np.int64)]
        lists = pa.ListArray.from_arrays(offsets, ids.take(pa.array(order))), pa.ListArray.from_arrays(offsets, pa.array(weights))
        return pa.RecordBatch.from_arrays([terms.take(pa.array(of)), pa.array(np.floor(tops * LEVELS).astype(np.int32)), pa.array(tops), *lists], names=schema.names)

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or size >= CHUNK):
                many = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
                ids = pa.concat_arrays([b.column(0) for b in held]).take(pa.array(np.repeat(np.arange(len(many)), many)))
                coded = pa.concat_arrays([b.column(1).flatten() for b in held]).dictionary_encode()
                yield cut(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), ids, np.concatenate([b.column(2).flatten().to_numpy() for b in held]))
                held, size = [], 0
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += len(batch.column(1).flatten())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full blocks pass; what is left of a term, row after row, is put together and cut again. The last term of a batch waits for the next."""
        held: pa.RecordBatch | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                full = pa.array(np.diff(batch.column(3).offsets.to_numpy()) == BLOCK)
                yield batch.filter(full)
                batch = batch.filter(pc.invert(full))
                if not batch.num_rows:
                    continue
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None or not held.num_rows:
                continue
            last = held.column(0)[held.num_rows - 1]
            ready = held.num_rows if batch is None or len(held.column(3).flatten()) >= MERGED else int(np.argmax(pc.equal(held.column(0), last).to_numpy(zero_copy_only=False)))
            if ready:
                now, held = held.slice(0, ready), held.slice(ready)
                coded = now.column(0).dictionary_encode()
                many = np.diff(now.column(3).offsets.to_numpy())
                yield cut(coded.dictionary, np.repeat(coded.indices.to_numpy(zero_copy_only=False), many), now.column(3).flatten(), now.column(4).flatten().to_numpy())

    bucket = bucket_of(F.col("term"), buckets)
    full = F.size("docs") == BLOCK
    loose = documents.mapInArrow(sorted_, schema).withColumn("_bucket", bucket).withColumn("_deal", F.when(full, F.pmod(F.xxhash64("docs"), F.lit(spread))).otherwise(F.lit(0)))
    met = loose.repartition("_bucket", "_deal").sortWithinPartitions("_bucket", "term", F.size("docs")).select(*schema.names)
    return met.mapInArrow(merged, schema).withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", F.desc("top"))


class Store:
    """An index that `write` made. Its folders are not listed: a request names the buckets it reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stats = spark.read.parquet(f"{path}/stats").first()
        self.doc_type = T._parse_datatype_string(self.stats.doc_type)

    def _read(self, kind: str, by: str, values: list[int], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{by}={v}" for v in values])

    def buckets(self, terms: list[bytes]) -> list[int]:
        return sorted({zlib.crc32(t) % self.stats.buckets for t in terms}.intersection(self.stats.used))

    def terms(self, terms: list[bytes]) -> dict[bytes, tuple[int, list[tuple[int, int]]]]:
        """df, and (level, postings) from the highest level down, of those of the terms that the corpus has."""
        found = self.buckets(terms)
        if not found:
            return {}
        rows = self._read("terms", "bucket", found, "term string, df long, levels array<struct<level:int,n:long>>, bucket int").filter(F.col("term").isin([t.decode() for t in terms]))
        return {r.term.encode(): (r.df, sorted(((x.level, x.n) for x in r.levels), reverse=True)) for r in rows.collect()}

    def blocks(self, cuts: dict[bytes, int]) -> DataFrame:
        """The blocks of the terms from a level up each: their buckets' files only, and of these the row groups that can hold them."""
        kind = self.doc_type.simpleString()
        read = self._read("blocks", "bucket", self.buckets(list(cuts)), f"term string, level int, top double, docs array<{kind}>, weights array<double>, bucket int")
        if len(cuts) <= FILTERS:
            # Terms are letters, digits and a few signs, none of them a quote.
            return read.filter(" or ".join(f"(term = '{t.decode()}' and level >= {level})" for t, level in sorted(cuts.items())))
        cut = self.spark.createDataFrame([(t.decode(), level) for t, level in cuts.items()], "term string, cut int")
        return read.join(F.broadcast(cut), "term").filter("level >= cut").drop("cut")

    def documents(self, ids: list) -> DataFrame:
        parts = sorted({zlib.crc32(str(i).encode()) % self.stats.parts for i in ids})
        return self._read("documents", "part", parts, f"doc_id {self.stats.doc_type}, terms array<string>, weights array<double>, part int").filter(F.col("doc_id").isin(ids) if len(ids) <= FILTERS else F.lit(True))

    def weight(self, df: int) -> float:
        if self.stats.form == "a":
            return index.positive_idf(df, self.stats.n)
        raw = math.log(self.stats.n - df + 0.5) - math.log(df + 0.5)
        return raw if raw >= 0 else 0.25 * self.stats.mean

    def search(self, queries: DataFrame, query_id: str, query_text: str, k: int, digits: int = 6, head: int | None = None) -> DataFrame:
        """query_id, doc_id, rank and score (rounded to `digits`) of each query's first k documents, ties to the lesser doc_id; those
        without a common term are absent. The queries' terms come to the driver: WANTED of them at the most, else it is an error."""
        tokens = FORMS[self.stats.form][1](query_text)
        tokens = F.array_distinct(tokens) if self.stats.form == "a" else tokens
        wanted = queries.select(query_id, F.explode(tokens).alias("term")).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("times"))
        asked = index.asked_for(wanted, query_id)
        if asked is None:
            raise ValueError(f"more than {index.WANTED} terms in one request")
        return self.answer(asked, queries.schema[query_id], k, digits, head)

    def request(self, texts: dict, k: int, query: str = "query_id", digits: int = 6, head: int | None = None) -> DataFrame:
        """`search` for a few texts by their id, without a job for their terms."""
        times: dict[tuple[bytes, int], int] = {}
        for q, text in enumerate(texts.values()):
            for t in FORMS[self.stats.form][0].terms(text):
                times[t, q] = 1 if self.stats.form == "a" else times.get((t, q), 0) + 1
        terms = sorted({t for t, _ in times})
        kind = T.LongType() if all(isinstance(x, int) for x in texts) else T.StringType()
        return self.answer(index.Asked(list(texts), terms, {(terms.index(t), q): n for (t, q), n in times.items()}), T.StructField(query, kind), k, digits, head)

    def answer(self, asked: index.Asked, query: T.StructField, k: int, digits: int = 6, head: int | None = None) -> DataFrame:
        out = T.StructType([query, T.StructField("doc_id", self.doc_type), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
        known = self.terms(asked.terms)
        weight = {t: self.weight(df) for t, (df, _) in known.items()}
        # As deep for each term as a small request can be read at once.
        margin, depth = 2 * 10.0**-digits, head if head is not None else max(HEAD, FIRST // max(1, len(known)))
        pairs = [(asked.terms[t].decode(), q, n * weight[asked.terms[t]]) for (t, q), n in asked.times.items() if asked.terms[t] in known]
        while known:
            cuts, unread, size = {}, {}, 0
            for t, (_, levels) in known.items():
                # Weights below 0 only take away, so their terms are read whole: sums are then lower bounds.
                so_far = list(itertools.accumulate(n for _, n in levels))
                upto = next((i for i, n in enumerate(so_far) if n >= depth), len(levels) - 1) if weight[t] >= 0 else len(levels) - 1
                cuts[t], size = levels[upto][0], size + so_far[upto]
                # A level's blocks have tops below its upper end.
                unread[t] = (levels[upto + 1][0] + 1) / LEVELS if upto + 1 < len(levels) else 0.0
            bound = [(t, q, w, w * unread[t.encode()] if w > 0 else 0.0) for t, q, w in pairs]
            rest = dict.fromkeys(range(len(asked.queries)), 0.0)
            for _, q, _, r in bound:
                rest[q] += r
            if size <= DRIVER:
                found = self.few(cuts, bound, rest, k, margin)
                if found is not None:
                    sure, unsure = found
                    sure += [(r["_q"], r.doc_id, r.score) for r in self.whole(unsure, bound).collect()] if unsure else []
                    best: dict[int, list] = {}
                    for q, doc, score in sure:
                        best.setdefault(q, []).append((-round(score, digits), doc))
                    return self.spark.createDataFrame([(asked.queries[q], doc, i + 1, -score) for q, rows in best.items() for i, (score, doc) in enumerate(sorted(rows)[:k])], out)
            elif len(asked.queries) > PASS:
                return self.passed(asked, weight, query, k, digits)
            elif (found := self.many(cuts, bound, rest, k, margin)) is not None:
                sure, unsure = found
                sure = sure.unionByName(self.whole(unsure, bound)) if unsure else sure
                names = self.spark.createDataFrame(list(enumerate(asked.queries)), T.StructType([T.StructField("_q", T.IntegerType()), query]))
                ranked = index.top_k(sure.withColumn("score", F.round("score", digits)), k, "_q", [F.desc("score"), F.asc("doc_id")])
                return checkpointed(ranked.join(F.broadcast(names), "_q").select(query.name, "doc_id", "rank", "score"))
            depth *= 4
        return self.spark.createDataFrame([], out)

    def passed(self, asked: index.Asked, weight: dict[bytes, float], query: T.StructField, k: int, digits: int) -> DataFrame:
        """The answer from a pass over the documents' own postings. A task gives little more than its first k of each query."""
        kind = self.doc_type.simpleString()
        read = self.spark.read.schema(f"doc_id {kind}, terms array<string>, weights array<double>").parquet(f"{self.path}/documents")
        names, terms = pa.array(asked.queries, to_arrow(query.dataType)), pa.array([t.decode() for t in asked.terms], pa.string())
        shared = self.spark.sparkContext.broadcast((names, terms, *index.weighed(asked, weight)))
        schema = T.StructType([query, T.StructField("doc_id", self.doc_type), T.StructField("score", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, terms, table, has = shared.value
            step, heads = max(1, index.SCORES // len(names)), index.Heads(len(names), k)
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    code = pc.index_in(part.column(1).flatten(), value_set=terms)
                    hits = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                    code, posting = code.fill_null(0).to_numpy()[hits], part.column(2).flatten().to_numpy()[hits]
                    ends = np.searchsorted(hits, np.cumsum(np.diff(part.column(1).offsets.to_numpy())))
                    doc, asked_by, score = [], [], []
                    for d, (first, end) in enumerate(zip([0, *ends], ends)):
                        if first < end:
                            at = code[first:end]
                            hit = np.flatnonzero(has[at].any(axis=0))
                            asked_by.append(hit)
                            score.append((posting[first:end] @ table[at])[hit])
                            doc.append(np.full(len(hit), d))
                    if doc:
                        doc, asked_by, score = (np.concatenate(x) for x in (doc, asked_by, score))
                        kept = heads.kept(doc, asked_by, score, part.num_rows)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(asked_by[kept])), part.column(0).take(pa.array(doc[kept])), pa.array(score[kept])], names=schema.names)

        found = read.mapInArrow(run, schema).withColumn("score", F.round("score", digits))
        return index.top_k(found, k, query.name, [F.desc("score"), F.asc("doc_id")]).select(query.name, "doc_id", "rank", "score")

    def pairs_of(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("doc_id", self.doc_type)]))

    def few(self, cuts: dict[bytes, int], bound: list[tuple], rest: dict[int, float], k: int, margin: float) -> tuple[list, list] | None:
        """((_q, doc_id, score) of documents whose sums are whole; (_q, doc_id) of others that may reach a place), or None where more must be
        read. For requests that read DRIVER postings at the most: one job, the sums are made here."""
        read = self.blocks(cuts).select("term", "docs", "weights").toArrow()
        coded = pa.concat_arrays([c.flatten() for c in read.column(1).chunks] or [pa.array([], pa.int64())]).dictionary_encode()
        code, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        posting = np.concatenate([c.flatten().to_numpy() for c in read.column(2).chunks] or [np.zeros(0)])
        many = np.concatenate([np.diff(c.offsets.to_numpy()) for c in read.column(1).chunks] or [np.zeros(0, np.int64)])
        own: dict[str, list] = {}
        for t, q, w, r in bound:
            own.setdefault(t, []).append((q, w, r))
        at = np.cumsum(many) - many
        seen = {q: (np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)) for q in rest}
        for t, lo, n in zip(read.column(0).to_pylist(), at, many):
            some = code[lo : lo + n]
            for q, w, r in own.get(t, []):
                seen[q][0][some] += w * posting[lo : lo + n]
                seen[q][1][some] += r
                seen[q][2][some] = True
        sure, unsure = [], []
        for q, (total, closed, hit) in seen.items():
            here = np.flatnonzero(hit)
            kth = np.partition(total[here], len(here) - k)[len(here) - k] if len(here) >= k else -math.inf
            if rest[q] > 0 and not rest[q] < kth - margin:
                return None
            open_ = np.maximum(rest[q] - closed[here], 0.0)
            reach = total[here] + open_ >= kth - margin
            sure += [(q, ids[d], float(total[d])) for d in here[reach & (open_ <= 1e-12)]]
            unsure += [(q, ids[d]) for d in here[reach & (open_ > 1e-12)]]
        return (sure, unsure) if len(unsure) <= UNSURE else None

    def many(self, cuts: dict[bytes, int], bound: list[tuple], rest: dict[int, float], k: int, margin: float) -> tuple[DataFrame, list] | None:
        """As `few`, for any number of postings: sums are grouped by Spark and written."""
        sums = checkpointed(self.sums(cuts, bound))
        best = Window.partitionBy("_q").orderBy(F.desc("seen"))
        kth = {r["_q"]: r.seen for r in sums.withColumn("_place", F.row_number().over(best)).filter(F.col("_place") == k).select("_q", "seen").collect()}
        if not all(r == 0 or (q in kth and r < kth[q] - margin) for q, r in rest.items()):
            return None
        limits = self.spark.createDataFrame([(q, rest[q], kth.get(q, -math.inf)) for q in rest], "_q int, rest double, kth double")
        # What a document may have beyond what was seen: the unread parts of the terms it was not seen in.
        reach = sums.join(F.broadcast(limits), "_q").withColumn("open", F.greatest(F.col("rest") - F.col("closed"), F.lit(0.0))).filter(F.col("seen") + F.col("open") >= F.col("kth") - margin)
        unsure = [(r["_q"], r.doc_id) for r in reach.filter("open > 1e-12").select("_q", "doc_id").limit(UNSURE + 1).collect()]
        return (reach.filter("open <= 1e-12").select("_q", "doc_id", F.col("seen").alias("score")), unsure) if len(unsure) <= UNSURE else None

    def whole(self, pairs: list[tuple], bound: list[tuple]) -> DataFrame:
        """_q, doc_id and score of pairs of them, from the documents' own postings."""
        own = self.documents(sorted({i for _, i in pairs})).select("doc_id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.weights").alias("posting"))
        return own.join(F.broadcast(self.small(bound)), "term").join(F.broadcast(self.pairs_of(pairs)), ["_q", "doc_id"]).groupBy("_q", "doc_id").agg(F.sum(F.col("w") * F.col("posting")).alias("score"))

    def small(self, bound: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(bound, "term string, _q int, w double, r double")

    def sums(self, cuts: dict[bytes, int], bound: list[tuple]) -> DataFrame:
        """_q, doc_id, seen (the sum of what was read) and closed (the bounds of the terms that it was read for)."""
        read = self.blocks(cuts).select("term", F.explode(F.arrays_zip("docs", "weights")).alias("x")).select("term", F.col("x.docs").alias("doc_id"), F.col("x.weights").alias("posting"))
        # The queries' terms are bounded by WANTED.
        met = read.join(F.broadcast(self.small(bound)), "term")
        return met.groupBy("_q", "doc_id").agg(F.sum(F.col("w") * F.col("posting")).alias("seen"), F.sum("r").alias("closed"))

