"""Language-model scores by prediction by partial matching over the bytes of texts.

A text is its words, each closed by a space, and one end. It is coded byte by byte; contexts are the ORDER bytes before, across words. A
byte's code length depends on the ORDER + 1 bytes up to it alone (a gram), so it is worked out once per distinct gram. The trie is never
in one place: grams meet by the last two bytes of their context, where all that orders 2 and up need of them lies, and orders 0 and 1,
65,536 symbols at most whatever the input, go to every task. Each block of texts gets the code lengths of its own grams back.

`score` is the same model over isolated words, with contexts that reach back to the space before the word. At each byte the longest known context is tried first. The escape to the next shorter one has the
probability d / (n + d), with n symbols and d distinct ones seen; symbols of the contexts escaped from are excluded. All that was
seen after a context was also seen after its suffix, so what is excluded is known for each context in advance.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from . import words
from .blocks import by_document, distinct_tokens, gather, postings, taught
from .store import written
from .words import text_bytes

#: Longest context in bytes, and the most symbols of contexts that a model of isolated words holds: the rarest beyond go, in whole classes of counts.
ORDER = 5
MAX_SYMBOLS = 2_000_000
END = "\n"
END_HASH = words.hashed(np.frombuffer(END.encode(), np.uint8), np.array([0]), np.array([1]))
#: Bytes of text whose grams are asked for together, and grams that are worked out together (whole groups of the same two last bytes).
TEXT_BLOCK = 16 << 20
BUNDLE = 400_000
U = np.uint64


def _coded(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, place in its token, token) of all tokens: a space, the word and a space; or a space and the end."""
    offsets, data = text_bytes(tokens)
    offsets = offsets - (base := offsets[0])
    data = data[base : base + offsets[-1]]
    n = np.diff(offsets)
    ends = (n == 1) & (data[np.minimum(offsets[:-1], max(len(data) - 1, 0))] == 10) if len(data) else np.zeros(len(n), bool)
    size = n + 2 - ends
    starts = np.concatenate([[0], np.cumsum(size)])
    out = np.full(starts[-1], 32, np.uint8)
    owner = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(data)) - offsets[owner] + starts[owner] + 1] = data
    token = np.repeat(np.arange(len(n)), size)
    return out, np.arange(len(out)) - starts[token], token


def _contexts(c: np.ndarray, at: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Keys of the k bytes before each position."""
    key = np.zeros(len(at), U)
    for back in range(k, 0, -1):
        key = (key << U(8)) | c[np.maximum(at - back, 0)]
    return key | U(k << 56)


def symbol_counts(tokens: pa.Array, times: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys of context and symbol, counts) over tokens that occur so many times. A key is the order, the context and the symbol."""
    c, place, token = _coded(tokens)
    keys, counts = [], []
    for k in range(order + 1):
        at = np.flatnonzero(place >= max(k, 1))
        context = _contexts(c, at, place, k)
        keys.append(((context & U((1 << 56) - 1)) << U(8)) | c[at] | U(k << 56))
        counts.append(times[token[at]])
    return merged(np.concatenate(keys), np.concatenate(counts))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    k, n = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class Model:
    """Sorted arrays of a trie: symbols of contexts with counts, and contexts with totals and what their suffix shares with them."""

    symbols: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    distinct: np.ndarray
    shared: np.ndarray
    order: int

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Model:
        by = np.argsort(keys)
        keys, counts = keys[by].astype(U), counts[by].astype(np.float64)
        k = keys >> U(56)
        body = keys & U((1 << 56) - 1)
        context = (body >> U(8)) | (k << U(56))
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        mask = (U(1) << (U(8) * np.maximum(k, U(1)))) - U(1)  # the symbol and the context without its first byte
        suffix = np.where(k > 0, (body & mask) | ((np.maximum(k, U(1)) - U(1)) << U(56)), keys)
        in_suffix = np.where(k > 0, counts[np.minimum(np.searchsorted(keys, suffix), max(len(keys) - 1, 0))], 0.0) if len(keys) else counts
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        return Model(keys, counts, context[first], add(counts), np.diff(np.append(first, len(keys))).astype(np.float64), add(in_suffix), order)

    def log10(self, tokens: pa.Array) -> np.ndarray:
        """log10 of each token's probability."""
        c, place, token = _coded(tokens)
        at = np.flatnonzero(place > 0)
        grams = ((_contexts(c, at, place, self.order) & U((1 << 56) - 1)) << U(8)) | c[at]
        return np.bincount(token[at], self.of_grams(grams, place[at]), minlength=len(tokens))

    def of_grams(self, grams: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it, of which `place` (all, if None) are there."""
        out = np.zeros(len(grams))
        out_total, out_distinct = np.zeros(len(grams)), np.zeros(len(grams))
        live = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            if not len(self.contexts) or not len(live):
                break
            i = live if place is None else live[place[live] >= k]
            sym = (grams[i] & U((1 << 8 * (k + 1)) - 1)) | U(k << 56)
            key = ((sym & U((1 << 56) - 1)) >> U(8)) | U(k << 56)
            j = np.minimum(np.searchsorted(self.contexts, key), len(self.contexts) - 1)
            known = self.contexts[j] == key
            i, j, sym = i[known], j[known], sym[known]
            total, distinct = self.totals[j] - out_total[i], self.distinct[j] - out_distinct[i]
            s = np.minimum(np.searchsorted(self.symbols, sym), len(self.symbols) - 1)
            hit = self.symbols[s] == sym
            with np.errstate(divide="ignore", invalid="ignore"):
                out[i] += np.where(hit, np.log(self.counts[s]) - np.log(total + distinct), np.where(distinct > 0, np.log(distinct) - np.log(total + distinct), 0.0))
            out_total[i], out_distinct[i] = self.shared[j], self.distinct[j]
            coded = np.zeros(len(grams), bool)
            coded[i[hit]] = True
            live = live[~coded[live]]
        out[live] -= np.log(256 - np.minimum(out_distinct[live], 255))
        return out / np.log(10)


def train(vocabulary: DataFrame, order: int = ORDER, max_symbols: int = MAX_SYMBOLS) -> Model:
    """A model from all of a vocabulary (token, c > 0). Counts are summed on the executors; the driver gets `max_symbols` rows at most.

    If there are more, all symbols below the least count that fits go. A symbol is never rarer after a context's suffix than after the
    context, so suffixes keep all that their contexts keep.
    """

    def run(batches):
        keys, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for batch in batches:
            k, n = symbol_counts(batch.column(0), batch.column(1).to_numpy(), order)
            keys, counts = merged(np.concatenate([keys, k]), np.concatenate([counts, n]))
            if len(keys) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])

    trie = written(vocabulary.where("c > 0").select("token", "c").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "symbols")
    classes = sorted(((r["b"], r["m"]) for r in trie.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    held, least = 0, 0
    for b, m in classes:
        held += m
        if held > max_symbols:
            least = 2 ** (b + 1)
            break
    rows = trie.where(F.col("n") >= least).toArrow()
    return Model.of(rows["k"].to_numpy().view(U), rows["n"].to_numpy(), order)


def score(docs: DataFrame, training, text: str = "text", key: str = "doc_id", order: int = ORDER, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """One row per row of docs: key, held_out (not `training`), n_tokens, n_known, train_tokens, base_score and score.

    Tokens are the words of the whole text, A-Z in lower case, and one end. base_score is the unigram score with add-one smoothing,
    score the model's log10 probability of the text. A null or empty text is its end token. A null `training` counts as false. Null keys
    and repeated rows are rows of their own. With nothing to learn from every byte has the probability 1/256. Other columns are not read.
    """
    learn = F.coalesce(training, F.lit(False))
    info = [F.col(key).alias("key"), (~learn).alias("held_out")]
    post = written(postings(docs, F.col(text), info, lower=True, mark=learn, end=END), "postings")
    vocabulary = written(post.where("token is not null").groupBy("token").agg(F.sum(taught()).alias("c")), "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    model = docs.sparkSession.sparkContext.broadcast(train(vocabulary, order, max_symbols))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.value.log10(part.column(0)))], names=["token", "c", "ppm"])

    scored = vocabulary.select("token", "c").mapInArrow(run, "token string, c long, ppm double").select(
        "token", "ppm", F.lit(1).alias("one"), (F.col("c") > 0).cast("int").alias("known"), F.log10((F.col("c") + 1) / F.lit(float(total["n"] + total["v"] + 1))).alias("base"))
    out = by_document(post.join(scored, "token", "left"), ["key", "held_out"], n_tokens="one", n_known="known", base_score="base", score="ppm")
    return out.select(F.col("key").alias(key), "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
                      F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")


def squeezed(x: np.ndarray) -> bytes:
    """8-byte values as compressed planes of bytes: sorted keys share their high bytes, and code lengths repeat."""
    return len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def restored(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    return np.frombuffer(pa.decompress(b[4:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view(kind).ravel()


def text_grams(column: pa.Array):
    """For each chunk of rows [i, j): i, j, the gram of every coded byte of each text, and its row from i.

    A text is coded as its words with a space after each, and END. What stands before it are four ENDs and a space.
    """
    offsets, data = text_bytes(column)
    for i, j in words.chunks(offsets):
        c = words.LOWER[data[offsets[i] : offsets[j]]]
        start, end, row = words.word_spans(c, offsets[i:j] - offsets[i])
        size = np.bincount(row, end - start + 1, minlength=j - i).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
        x = np.full(at[-1], 32, np.uint8)
        coded = np.ones(len(x), bool)
        for k in range(ORDER):
            x[at[:-1] + k] = 32 if k == ORDER - 1 else ord(END)
            coded[at[:-1] + k] = False
        x[at[1:] - 1] = ord(END)
        if len(start):
            cuts, text = gather(c, start, end)
            # before a word lie the words of its chunk with a space each, and ORDER bytes for each text so far and an END for each but its own
            to = cuts[:-1] + np.arange(len(start)) + (row + 1) * ORDER + row
            x[np.arange(len(text)) + np.repeat(to - cuts[:-1], end - start)] = text
        gram = np.zeros(len(x), U)
        for back in range(ORDER, -1, -1):
            gram[ORDER:] = (gram[ORDER:] << U(8)) | x[ORDER - back : len(x) - back]
        yield i, j, gram[coded], np.repeat(np.arange(j - i), size + 1)


def score_texts(docs: DataFrame, training, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As `score`, but with contexts across words and with all symbols of the training texts, however rare and however many."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(training, F.lit(False)).alias("learn"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = T.StructType([*src.schema.fields, T.StructField("rid", T.LongType()), T.StructField("block", T.LongType())])

    def number(batches):
        task = TaskContext.get().partitionId() << 40
        n, size = 0, 0
        for batch in batches:
            offsets, _ = text_bytes(batch.column(2))
            block = task + (size + offsets[:-1] - offsets[0]) // TEXT_BLOCK
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + n + np.arange(batch.num_rows)), pa.array(block)], names=numbered.names)
            n, size = n + batch.num_rows, size + int(offsets[-1] - offsets[0])

    rows = written(src.mapInArrow(number, numbered), "rows", compression="zstd")
    def low_orders(batches):
        held = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, gram, _ in text_grams(batch.column(0)):
                held += np.bincount((gram & U(0xFFFF)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["k", "n"])

    pairs = rows.where("learn").select("text").mapInArrow(low_orders, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = pairs["k"].to_numpy().astype(U), pairs["n"].to_numpy()
    short = [merged(k & U(0xFF), n), (k | U(1 << 56), n)]
    spread = docs.sparkSession.sparkContext.broadcast(tuple(np.concatenate(x) for x in zip(*short)))

    def ask(batches):
        own, parts = None, []

        def sent():
            if not parts:
                return
            keys, counts = merged(*(np.concatenate(x) for x in zip(*parts)))
            for a in range(0, len(keys), 50_000):
                part = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(counts[a : a + 50_000]), pa.array(np.full(len(part), own))], names=["k", "n", "block"])

        for batch in batches:
            learn, block = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if block[a] != own:
                    yield from sent()
                    own, parts = block[a], []
                for i, _, gram, row in text_grams(batch.column(0).slice(a, b - a)):
                    parts.append(merged(gram, learn[a + i + row].astype(np.int64)))
        yield from sent()

    last_two = F.shiftrightunsigned("k", 8).bitwiseAND(0xFFFF)
    asked = rows.select("text", "learn", "block").mapInArrow(ask, "k long, n long, block long").repartition(last_two).sortWithinPartitions(last_two)
    reply = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("grams", T.BinaryType()), T.StructField("logs", T.BinaryType())])

    def answer(batches):
        held: list[tuple] = []
        size = 0

        def worked(parts):
            gram, n, block = (np.concatenate([p[i] for p in parts]) for i in range(3))
            keys, counts = merged(gram, n)
            seen, times = keys[counts > 0], counts[counts > 0]
            orders = [merged((seen & U((1 << 8 * (k + 1)) - 1)) | U(k << 56), times) for k in range(2, ORDER + 1)]
            model = Model.of(*(np.concatenate(x) for x in zip(spread.value, *orders)))
            logs = model.of_grams(keys)
            by = np.lexsort((gram, block))
            gram, block = gram[by], block[by]
            found = logs[np.searchsorted(keys, gram)]
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            cells = [(block[a], squeezed(gram[a:b]), squeezed(found[a:b])) for a, b in zip(edges, edges[1:])]
            for a in range(0, len(cells), 500):
                b, g, x = zip(*cells[a : a + 500])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([0] * len(b), pa.int32()), pa.array(g, pa.binary()), pa.array(x, pa.binary())], names=reply.names)

        for batch in batches:
            gram, n, block = batch.column(0).to_numpy().view(U), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(gram):
                continue
            group = (gram >> U(8)) & U(0xFFFF)
            begins = group != np.concatenate([[((held[-1][0][-1] >> U(8)) & U(0xFFFF)) if held else group[0]], group[:-1]])
            a = 0
            for b in np.flatnonzero(begins):
                if size + b - a >= BUNDLE:  # a new group begins, and enough is held
                    held.append((gram[a:b], n[a:b], block[a:b]))
                    yield from worked(held)
                    held, size, a = [], 0, b
            held.append((gram[a:], n[a:], block[a:]))
            size += len(gram) - a
        if size:
            yield from worked(held)

    def tally(batches):
        """Distinct tokens of each block with how often its training texts hold them."""
        own, parts, ends = None, [], 0

        def sent():
            if own is None:
                return
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends]), pa.array([own], pa.int64())], names=["token", "n", "block"])
            if not parts:
                return
            tokens, cuts, _, n = distinct_tokens(parts)
            n = np.add.reduceat(n, cuts[:-1])
            for a in range(0, len(tokens), 50_000):
                t = tokens.slice(a, 50_000)
                yield pa.RecordBatch.from_arrays([t, pa.array(n[a : a + 50_000]), pa.array(np.full(len(t), own))], names=["token", "n", "block"])

        for batch in batches:
            learn, block = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if block[a] != own:
                    yield from sent()
                    own, parts, ends = block[a], [], 0
                ends += int(learn[a:b].sum())
                for i, _, c, row, start, end, h in words.hashed_words(batch.column(0).slice(a, b - a)):
                    if len(h):
                        once, first, back = np.unique(h, return_index=True, return_inverse=True)
                        lo, text = gather(c, start[first], end[first])
                        n = np.bincount(back, learn[a + i + row], minlength=len(once)).astype(np.int64)
                        parts.append((once, np.zeros(len(once), np.int64), n, lo[:-1], text, lo[1:]))
        yield from sent()

    def pack(batches):
        """Counts of tokens by block, and what a task's tokens come to in all: how many they are in training texts and how many are distinct there."""
        held, size, total = [], 0, np.zeros(2, np.int64)

        def cells():
            block, h, c = (np.concatenate([x[i] for x in held]) for i in range(3))
            by = np.lexsort((h, block))
            block, h, c = block[by], h[by], c[by]
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            got = [(int(block[a]), 1, squeezed(h[a:b]), squeezed(c[a:b])) for a, b in zip(edges, edges[1:])]
            yield _replies(got)

        for batch in batches:
            block, n, c, new = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            if not len(block):
                continue
            offsets, data = text_bytes(batch.column(0))
            h = words.hashed(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
            total += int(n.sum()), int(((c > 0) & new).sum())
            held.append((block, h, c))
            size += len(h)
            if size >= BUNDLE:
                yield from cells()
                held, size = [], 0
        if size:
            yield from cells()
        yield _replies([(-1, 3, total.tobytes(), b"")])

    def _replies(got):
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*got), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=reply.names)

    token = W.partitionBy("token").orderBy("block")
    tallied = rows.select("text", "learn", "block").mapInArrow(tally, "token string, n long, block long")
    counted = tallied.select("token", "block", "n", F.sum("n").over(token.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("c"), (F.row_number().over(token) == 1).alias("new"))
    none = lambda kind: F.lit(None).cast(kind)
    answers = asked.mapInArrow(answer, reply).unionByName(counted.mapInArrow(pack, reply)).select("*", none("string").alias("text"), none("long").alias("rid"))
    texts = rows.select("block", F.lit(2).alias("kind"), none("binary").alias("grams"), none("binary").alias("logs"), "text", "rid")
    met = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    result = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def add(batches):
        own, parts, tokens, keys, logs, hashes, seen = None, [], [], None, None, None, None
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            edges = np.concatenate([[0], cuts, [len(block)]])
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if block[a] != own:
                    own, parts, tokens, keys = block[a], [], [], None
                if kind[a] == 3:
                    n, v = (list(x) for x in zip(*(np.frombuffer(g.as_py(), np.int64).tolist() for g in batch.column(2).slice(a, b - a))))
                    yield pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), pa.array(n, pa.int64()), pa.array(v, pa.int64()), pa.nulls(b - a, pa.float64()), pa.nulls(b - a, pa.float64())], names=result.names)
                    continue
                if kind[a] == 1:
                    tokens += [(restored(g.as_py(), U), restored(x.as_py(), np.int64)) for g, x in zip(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a))]
                    continue
                if kind[a] == 0:
                    parts += [(restored(g.as_py(), U), restored(x.as_py(), np.float64)) for g, x in zip(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a))]
                    continue
                if keys is None:
                    keys, logs = (np.concatenate([p[i] for p in parts]) for i in range(2))
                    by = np.argsort(keys)
                    keys, logs, parts = keys[by], logs[by], []
                    hashes, seen = (np.concatenate([p[i] for p in tokens]) for i in range(2))
                    by = np.argsort(hashes)
                    hashes, seen, tokens = hashes[by], seen[by], []
                closed = seen[np.searchsorted(hashes, END_HASH)][0]  # of the end that every text has
                out, n, known, base = np.zeros(b - a), np.ones(b - a, np.int64), np.full(b - a, int(closed > 0)), np.full(b - a, np.log10(closed + 1.0))
                for i, j, _, row, _, _, h in words.hashed_words(batch.column(4).slice(a, b - a)):
                    once, back = np.unique(h, return_inverse=True)
                    at = np.searchsorted(hashes, once)
                    assert (hashes[at] == once).all()
                    n[i:j] += np.bincount(row, minlength=j - i)
                    known[i:j] += np.bincount(row, (seen[at] > 0)[back], minlength=j - i).astype(np.int64)
                    base[i:j] += np.bincount(row, np.log10(seen[at] + 1.0)[back], minlength=j - i)
                for i, j, gram, row in text_grams(batch.column(4).slice(a, b - a)):
                    once, back = np.unique(gram, return_inverse=True)
                    at = np.searchsorted(keys, once)
                    assert (keys[at] == once).all()
                    out[i:j] = np.bincount(row, logs[at][back], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(5).slice(a, b - a), pa.array(n), pa.array(known), pa.array(base), pa.array(out)], names=result.names)

    scored = written(met.mapInArrow(add, result), "scores", compression="zstd")
    total = scored.where("rid is null").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_known"), F.lit(0)).alias("v")).first()
    # log10((c + 1) / (N + V + 1)) summed over tokens: N and V are known only when every token has been counted
    out = rows.select("key", "learn", "rid").join(scored.where("rid is not null"), "rid")
    return out.select(F.col("key").alias(key), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total["n"] + total["v"] + 1)))).alias("base_score"), "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document, learned from all documents outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
