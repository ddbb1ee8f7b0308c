"""Language-model scoring: a Katz backoff model of any order with Good-Turing discounts.

P(w | h) of a history h of n words is d(c) * c / c(h) where the n-gram (h, w) has training count c, and
alpha(h) * P(w | h without its first word) where it has none; of no history it is d(c) * c / N, and all that is left for
the unknown word. d() are Katz's Good-Turing discounts up to a count of `most` and 1 above. alpha(h) makes P(. | h) sum
to one over the known words and the unknown one. Where no n-gram of a history is discounted, nothing would be left for
the others: there, and for unigrams, the denominator is one more.

Tables (Parquet in the shared folder, dealt out by a hash of their key):
  words  bucket, word (hash), id, c  the vocabulary of the training texts; an id is a number, small for frequent words
  n      w1..wn, c, total, weight    count of each n-gram, and as a history: the denominator and alpha (null for none)
Texts are tokenized once into chunks of documents. A chunk gives each of its n-grams once to be counted, and asks once
for its figures, whatever the number of occurrences, as packed arrays of ids for the n-gram's bucket. A frequent n-gram
is one entry for each chunk, and the n-grams of a frequent history lie in many buckets; sums over a history are
aggregated map-side. Figures come back in the order of the request. The recursion then runs for each n-gram of a chunk, from short to long.

Cases: null and empty texts are the end token alone; without training documents every token has probability one, as the
unknown word is all there is; repeated rows count each; null doc_ids are training documents; a text is never
split between chunks, whatever its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize

END, START = b" ", b"\n"  # no word holds these bytes
START_ID, UNKNOWN_ID = -1, -2
CHUNK_BYTES = 8_000_000
BUCKET_KEYS = 200_000
#: The bucket of an n-gram: the sum over its ids of their remainders by MODULUS, times a factor each, by the number of buckets.
MODULUS, FACTORS = 1_000_003, (1, 31_337, 611_953, 104_729, 15_331, 999_331, 7_919)


def _pack(x: np.ndarray) -> bytes:
    """Compressed, the first byte of every number before the second ones."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def chunks_of(documents: DataFrame, held_out: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, docs (doc_ids), held, sizes (tokens of each), width, vocab (`width` hashes; the end and the start first), tokens."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    bound_batches(documents.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest as xxh

        part, number, id_type = TaskContext.get().partitionId(), 0, pa.int64()

        def flush():
            vocab = np.array([xxh(w) for w in known], "<u8")
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()), pa.array([docs], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([len(vocab)], pa.int64()), pa.array([vocab.tobytes()], pa.binary()), pa.array([_pack(np.concatenate(tokens))], pa.binary())],
                names=["chunk", "docs", "held", "sizes", "width", "vocab", "tokens"],
            )

        def numbered():
            """Numbers for words, in the order in which they come."""
            out = defaultdict(count(2).__next__)
            out.update({END: 0, START: 1})
            return out

        docs, held, sizes, tokens, known, full = [], [], [], [], numbered(), 0
        for batch in batches:
            id_type = batch.column(0).type
            for doc, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode().lower()
                words = raw.split()
                words.append(END)
                docs.append(doc)
                held.append(out)
                sizes.append(len(words))
                tokens.append(np.fromiter(map(known.__getitem__, words), "<u4", len(words)))
                full += len(raw)
                if full >= chunk_bytes:
                    yield flush()
                    docs, held, sizes, tokens, known, full, number = [], [], [], [], numbered(), 0, number + 1
        if docs:
            yield flush()

    rows = documents.select("doc_id", "text", held_out.alias("held"))
    return rows.mapInArrow(run, f"chunk long, docs array<{kind}>, held array<boolean>, sizes array<long>, width long, vocab binary, tokens binary")


def _spread(bucket: np.ndarray, buckets: int):
    """Each bucket that has rows, with their places."""
    if buckets <= 1 << 16:  # numbers of two bytes are sorted by their bytes
        bucket = bucket.astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _words_by_bucket(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk; at (places in its vocabulary), words, c (training counts), packed. The start isn't a word."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in _columns(batch):
                vocab = np.frombuffer(row["vocab"], "<u8")
                train = np.repeat(~row["held"].astype(bool), row["sizes"])
                c = np.bincount(_unpack(row["tokens"], "<u4")[train], minlength=len(vocab))
                place = np.delete(np.arange(len(vocab), dtype=np.int32), 1)
                parts = [(b, row["chunk"], _pack(at), _pack(vocab[at]), _pack(c[at])) for b, at in ((b, place[i]) for b, i in _spread((vocab[place] % np.uint64(buckets)).astype(np.int64), buckets))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "at", "words", "c"])

    return chunks.drop("docs").mapInArrow(run, "bucket int, chunk long, at binary, words binary, c binary")


def word_buckets(chunks: DataFrame, bucket_keys: int = BUCKET_KEYS) -> int:
    most = chunks.agg(F.sum("width")).first()[0] or 0
    return max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // bucket_keys // 4))


def vocabulary(chunks: DataFrame, buckets: int) -> DataFrame:
    """bucket, word (hash), id, c of every training word."""

    def run(rows):
        import pandas as pd

        word, at = np.unique(np.concatenate([_unpack(x, "<u8") for x in rows["words"]]), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([_unpack(x, "<i8") for x in rows["c"]])).astype(np.int64)
        order = np.argsort(-c, kind="stable")[: np.count_nonzero(c)]
        b = int(rows["bucket"].iloc[0])
        return pd.DataFrame({"bucket": b, "word": word[order].view(np.int64), "id": np.arange(len(order), dtype=np.int64) * buckets + b, "c": c[order]})

    return _words_by_bucket(chunks, buckets).select("bucket", "words", "c").groupBy("bucket").applyInPandas(run, "bucket int, word long, id long, c long")


def encode(chunks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """chunks with `known` in place of vocab: places and ids (packed) of the words that are in `words`."""

    def run(asked, known):
        import pandas as pd

        ids = pd.Series(known["id"].to_numpy(), index=known["word"].to_numpy())
        out = []
        for chunk, at, word in zip(asked["chunk"], asked["at"], asked["words"], strict=True):
            found = ids.index.get_indexer(_unpack(word, "<i8"))
            some = found >= 0
            out.append((chunk, _pack(_unpack(at, "<i4")[some]), _pack(ids.to_numpy()[found[some]])))
        return pd.DataFrame(out, columns=["chunk", "at", "ids"])

    asked = _words_by_bucket(chunks, buckets).select("bucket", "chunk", "at", "words")
    found = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInPandas(run, "chunk long, at binary, ids binary")
    return chunks.drop("vocab").join(found.groupBy("chunk").agg(F.collect_list(F.struct("at", "ids")).alias("known")), "chunk", "left")


def _codes(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each row: equal, and in the same order, as the rows are."""
    code = columns[0]
    for x in columns[1:]:
        if len(x):
            if (int(code.max()) - int(code.min()) + 1) * (int(x.max()) - int(x.min()) + 1) >= 1 << 62:
                code, x = (np.unique(y, return_inverse=True)[1] for y in (code, x))
            code = (code - code.min()) * (x.max() - x.min() + 1) + (x - x.min())
    return code


@dataclass
class Grams:
    """The distinct n-grams of a chunk. ids: a column for each word; of: the n-gram that ends at each position.

    history, suffix: the numbers, among those one word shorter, of the n-gram without its last and its first word.
    Of the longest n-grams of a chunk that isn't to be scored, `of` and `suffix` are None.
    """

    ids: list[np.ndarray]
    of: np.ndarray | None
    history: np.ndarray
    suffix: np.ndarray | None

    def asked(self, buckets: int, some: np.ndarray | None = None):
        """For each bucket the n-grams in it. Those with an unknown word are in no table."""
        some = np.flatnonzero(np.logical_and.reduce([x != UNKNOWN_ID for x in self.ids])) if some is None else some
        bucket = sum(x[some] % MODULUS * f for x, f in zip(self.ids, FACTORS, strict=False)) % buckets
        for b, at in _spread(bucket, buckets):
            yield b, some[at]


class Chunk:
    """A chunk's texts, each after order - 1 start tokens, and their n-grams of 1 to `most` words."""

    def __init__(self, row, order: int, most: int | None = None, use: str = "score"):
        """use: "ask" has only the distinct n-grams of `most` words, "count" those of the training texts and their `counts`."""
        sizes, held = np.array(row["sizes"], np.int64), np.array(row["held"], bool)
        pad, v = order - 1, int(row["width"])
        self.docs, self.sizes, self.held = row.get("docs"), sizes, held
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + pad)
        at = np.arange(len(self.doc), dtype=np.int32) - (np.cumsum(sizes + pad) - sizes - pad).astype(np.int32)[self.doc]
        self.real = at >= pad
        self.train = self.real & ~held[self.doc]
        x = np.ones(len(self.doc), np.int32)
        x[self.real] = _unpack(row["tokens"], "<u4")
        ids = np.full(v, UNKNOWN_ID, np.int64)
        ids[1] = START_ID
        for part in row["known"] if row["known"] is not None else ():
            ids[_unpack(part["at"], "<i4")] = _unpack(part["ids"], "<i8")
        none = np.zeros(0, np.int64)
        self.grams = [Grams([ids], x, none, none)]
        most = most or order
        for n in range(2, most + 1):
            last = self.grams[-1]
            places = np.flatnonzero((at >= n - 1) & self.train if n == most and use == "count" else at >= n - 1)
            codes = last.of[places - 1].astype(np.int64) * v + x[places]
            of = suffix = None
            if n < most or use == "score":
                codes, inverse = np.unique(codes, return_inverse=True)
                of = np.full(len(x), -1, np.int32)
                of[places] = inverse
                suffix = np.empty(len(codes), np.int32)
                suffix[inverse] = last.of[places]
            else:
                codes, self.counts = np.unique(codes, return_counts=True)
            history, word = np.divmod(codes, v)
            self.grams.append(Grams([*(c[history] for c in last.ids), ids[word]], of, history, suffix))


def _names(n: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, first + n)]


def _columns(batch):
    """Rows of an Arrow batch as dictionaries whose lists of numbers are numpy arrays."""
    plain = ("sizes", "held")
    for j in range(batch.num_rows):
        yield {f.name: c[j].values.to_numpy(zero_copy_only=False) if f.name in plain else c[j].as_py() for f, c in zip(batch.schema, batch.columns, strict=True)}


def ngram_counts(encoded: DataFrame, n: int, buckets: int) -> DataFrame:
    """w1..wn, c of each n-gram (n of 2 or more) of the training texts."""

    def give(batches):
        import pyarrow as pa

        for batch in batches:
            for row in _columns(batch):
                chunk = Chunk(row, n, use="count")
                g, c = chunk.grams[-1], chunk.counts
                for b, at in g.asked(buckets, np.arange(len(c))):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([[_pack(x[at]) for x in g.ids]], pa.list_(pa.binary())), pa.array([_pack(c[at])], pa.binary())], names=["bucket", "keys", "c"])

    def add(rows):
        import pandas as pd

        keys = [np.concatenate([_unpack(k[j], "<i8") for k in rows["keys"]]) for j in range(n)]
        code = _codes(keys)
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        c = np.add.reduceat(np.concatenate([_unpack(c, "<i8") for c in rows["c"]])[order], first)
        return pd.DataFrame({w: k[order[first]] for w, k in zip(_names(n), keys, strict=True)} | {"c": c})

    rows = encoded.drop("docs").mapInArrow(give, "bucket int, keys array<binary>, c binary")
    return rows.groupBy("bucket").applyInPandas(add, ", ".join(f"{c} long" for c in [*_names(n), "c"]))


def discounts(counts_of_counts: list[int], most: int) -> list[float]:
    """Katz's discounts d(0..most) from n(1..most+1); where those aren't between 0 and 1, (r - 0.5) / r."""
    n = [0, *counts_of_counts]
    out = [1.0] * (most + 1)
    tail = (most + 1) * n[most + 1] / n[1] if n[1] else 1.0
    for r in range(1, most + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Model:
    """words and tables[n - 1]: the tables. n, v: training tokens, distinct ones. d: discounts of each order."""

    words: DataFrame
    tables: list[DataFrame]
    buckets: list[int]
    n: int
    v: int
    d: list[list[float]]
    unknown: float

    def discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        d = np.array(self.d[order - 1])
        return np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0) * c

    def without_tables(self) -> Model:
        return Model(None, [], self.buckets, self.n, self.v, self.d, self.unknown)


def _discounted(d: list[float]) -> Column:
    c = F.col("c")
    return F.when(c < len(d), F.get(F.array(*map(F.lit, d)), c.cast("int"))).otherwise(1.0) * c


def _figures(table: DataFrame, most: int) -> tuple[int, int, list[float]]:
    """Rows, tokens and discounts of a table of counts."""
    each = [F.count(F.when(F.col("c") == r, 1)) for r in range(1, most + 2)]
    size, tokens, *few = table.agg(F.count("*"), F.sum("c"), *each).first()
    return size, tokens or 0, discounts(few, most)


def fit(encoded: DataFrame, words: DataFrame, order: int = 2, most: int = 5, bucket_keys: int = BUCKET_KEYS) -> Model:
    """The model of the chunks' training texts, up to n-grams of `order` words."""
    least = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = words.select(F.col("id").alias("w1"), "c")
    v, n, d = _figures(level, most)
    found, buckets, tables = [d], [max(least, -(-v // bucket_keys))], []
    kept = level.agg(F.sum(_discounted(d))).first()[0] or 0.0
    level = level.withColumn("p", _discounted(d) / (n + 1))
    for k in range(2, order + 1):
        rows = materialize(ngram_counts(encoded, k, max(least, -(-n // bucket_keys // 4))), f"katz-{k}-grams")
        size, _, d = _figures(rows, most)
        low = level.select(*(F.col(a).alias(b) for a, b in zip(_names(k - 1), _names(k - 1, 2), strict=True)), "p")
        stats = rows.join(low, _names(k - 1, 2)).groupBy(*_names(k - 1)).agg(F.sum("c").alias("total"), F.sum(_discounted(d)).alias("kept"), F.sum("p").alias("low"))
        total = F.when(F.col("kept") < F.col("total") * (1 - 1e-12), F.col("total")).otherwise(F.col("total") + 1)
        weight = (1 - F.col("kept") / F.col("total")) / F.greatest(1 - F.col("low"), F.lit(1e-300))
        stats = materialize(stats.withColumn("total", total).select(*_names(k - 1), "total", weight.alias("weight")), f"katz-{k}-histories")
        tables.append(materialize(level.drop("p").join(stats, _names(k - 1), "full").withColumn("c", F.coalesce("c", F.lit(0).cast("bigint"))), f"katz-{k - 1}"))
        level = rows if k == order else rows.join(stats, _names(k - 1)).select(*_names(k), "c", (_discounted(d) / F.col("total")).alias("p"))
        found.append(d)
        buckets.append(max(least, -(-size // bucket_keys)))
        if k == order:
            discard(stats)
    none = F.lit(None)
    tables.append(level.select(*_names(order), "c", none.cast("bigint").alias("total"), none.cast("double").alias("weight")))
    return Model(words, tables, buckets, n, v, found, 1 - kept / (n + 1))


def _answers(encoded: DataFrame, table: DataFrame, n: int, order: int, buckets: int) -> DataFrame:
    """chunk, n, bucket; c, total, weight (packed): of the n-grams that a chunk asks for, in its order."""

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for row in _columns(batch):
                g = Chunk(row, order, n, use="ask").grams[n - 1]
                for b, at in g.asked(buckets):
                    keys = [[_pack(x[at]) for x in g.ids]]
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()), pa.array(keys, pa.list_(pa.binary()))], names=["bucket", "chunk", "keys"])

    def answer(asked, known):
        import pandas as pd

        keys = [[_unpack(k, "<i8") for k in row] for row in asked["keys"]]
        if not keys:
            return pd.DataFrame([], columns=["chunk", "n", "bucket", "c", "total", "weight"])
        code = _codes([np.concatenate([known[w].to_numpy(np.int64), *(k[j] for k in keys)]) for j, w in enumerate(_names(n))])
        place = pd.Index(code[: len(known)]).get_indexer(code[len(known) :])
        found = place >= 0

        def figures(name, kind):
            out = np.zeros(len(place), kind)
            if len(known):
                out[found] = known[name].fillna(0).to_numpy(kind)[place[found]]
            return out

        c, (total, weight) = figures("c", np.int64), (figures("total", np.int64), figures("weight", np.float64)) if n < order else (None, None)
        out, at = [], 0
        for chunk, k in zip(asked["chunk"], keys, strict=True):
            mine = slice(at, at + len(k[0]))
            more = (_pack(total[mine]), _pack(weight[mine])) if n < order else (None, None)
            out.append((chunk, n, asked["bucket"].iloc[0], _pack(c[mine]), *more))
            at += len(k[0])
        return pd.DataFrame(out, columns=["chunk", "n", "bucket", "c", "total", "weight"])

    asked = encoded.drop("docs").mapInArrow(ask, "bucket int, chunk long, keys array<binary>")
    mixed = "+".join(f"pmod({c}, {MODULUS}) * {f}L" for c, f in zip(_names(n), FACTORS, strict=False))
    known = table.select(*_names(n), "c", *(("total", "weight") if n < order else ())).withColumn("bucket", F.expr(f"cast(pmod({mixed}, {buckets}L) as int)"))
    return asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInPandas(answer, "chunk long, n int, bucket int, c binary, total binary, weight binary")


def probabilities(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document of the chunks."""
    order, kind, buckets = len(model.tables), encoded.schema["docs"].dataType.elementType.simpleString(), model.buckets
    found = None
    for n in range(1, order + 1):
        some = materialize(_answers(encoded, model.tables[n - 1], n, order, buckets[n - 1]), f"katz-answers-{n}")
        found = some if found is None else found.unionByName(some)
    model = model.without_tables()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def gather(g, answers, n):
        """Counts, totals and weights in the order of the chunk's n-grams; 0, 0 and 1 of what is in no table."""
        c, total, weight = np.zeros(len(g.ids[0]), np.int64), np.zeros(len(g.ids[0]), np.int64), np.ones(len(g.ids[0]))
        mine = answers[answers["n"] == n].set_index("bucket")
        for b, at in g.asked(buckets[n - 1]):
            row = mine.loc[b]
            c[at] = _unpack(row["c"], "<i8")
            if n < order:
                total[at], weight[at] = _unpack(row["total"], "<i8"), _unpack(row["weight"], "<f8")
        return c, total, np.where(total > 0, weight, 1.0)

    def run(rows, answers):
        import pandas as pd

        if not len(rows):
            return pd.DataFrame([], columns=names)
        chunk, before = Chunk(rows.iloc[0], order), None
        for n, g in enumerate(chunk.grams, 1):
            c, total, weight = gather(g, answers, n)
            if n == 1:
                words, p = c, np.where(c > 0, model.discounted(1, c) / (model.n + 1), model.unknown)
            else:
                p = np.where(c > 0, model.discounted(n, c) / np.maximum(before[0][g.history], 1), before[1][g.history] * p[g.suffix])
            before = total, weight
        of, doc, size = chunk.grams[-1].of[chunk.real], chunk.doc[chunk.real], len(chunk.sizes)
        word = chunk.grams[0].of[chunk.real]
        total = lambda x: np.bincount(doc, weights=x, minlength=size)
        base = np.log10((words + 1) / (model.n + model.v + 1))
        with np.errstate(divide="ignore"):
            logs = np.log10(p)
        return pd.DataFrame({
            "doc_id": pd.Series(list(chunk.docs), dtype=object), "held_out": chunk.held, "n_tokens": chunk.sizes, "n_known": total(words[word] > 0).astype(np.int64),
            "base_score": total(base[word]), "score": total(logs[of]),
        })

    scored = encoded.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(model.n).cast("bigint"))


def score(documents: DataFrame, held_out: Column, order: int = 2, most: int = 5, chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability).

    held_out: which documents (by their columns) the model doesn't learn from.
    """
    chunks = materialize(chunks_of(documents, held_out, chunk_bytes), "katz-chunks")
    buckets = word_buckets(chunks, bucket_keys)
    words = materialize(vocabulary(chunks, buckets), "katz-words")
    encoded = materialize(encode(chunks, words, buckets), "katz-encoded")
    discard(chunks)
    model = fit(encoded, words, order, most, bucket_keys)
    if order > 1:  # else the words are the table
        discard(words)
    return probabilities(encoded, model)


def by_remainder(doc_id: Column, folds: int = 7, remainder: int = 2) -> Column:
    """Whether the CRC-32 of doc_id as text leaves this remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == remainder
