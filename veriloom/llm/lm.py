"""Language-model scores of whole texts: a word unigram base and a causal self-attention model on subword ids.

Word counts cover the whole training side. A word's count is needed where the word stands, so rare words travel once,
with the documents that hold them, to the task that counts them; a bounded set of the words that are most frequent in the
training documents is known to all tasks, with its counts. The set decides who counts a word, never what the count is. The attention model
predicts subword ids: those of the frequent words, one id for any rare word, and the end. It learns from every window of all
training documents: the windows are dealt by hash into blocks of a fixed size and the blocks into rounds, every block trains the
model of the last round on its own, window after window, and the blocks' models are averaged. A word's
probability is a mixture of the product of its ids' probabilities and of its unigram; the mixture's weight is that of a grid
which scores all training documents best. Which rare word a rare word is follows the corpus counts plus one.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import filterfalse, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm._base import forget, importable, mark, partitions, release, sweep, text_of, written
from veriloom.llm.attention import NONE, STRIDE, WINDOW, Attention, laid_out
from veriloom.llm.packing import fast_encoder, tokenizer_path

NULL_ID = -(1 << 63)
#: Words known to all tasks at most: their table is broadcast (a few MB).
FREQUENT = 1 << 17
#: How often every window is learned from, at least.
LEARNING = 1
#: Windows of a block, training steps of a block at least, rounds.
BLOCK, STEPS, ROUNDS = 8192, 100, 2
#: Windows of a step.
BATCH = 96
#: Models that one task averages, and numbers of a part of a model.
FAN, PART = 64, 1 << 16
#: Distinct words that a task counts before it sends them on.
DISTINCT = 1 << 18
#: Words that are scored at once.
HELD = 1 << 15
#: Shares of the unigram that are tried.
MIXES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95)
TINY = np.float32(1e-37)
#: NONE in windows of two bytes an id.
SHORT_NONE = 0xFFFF
#: Odd numbers that hash a window's ids.
DEAL = np.multiply.accumulate(np.full(WINDOW + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 2 modulo 7; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Subwords:
    """Subword ids of a set of words, each with the blank before it; any other word is one id, `rare`, and a text ends with `end`."""

    def __init__(self, path: str, words: list[bytes]) -> None:
        encoding = fast_encoder(path)
        self.end, self.rare = encoding.n_vocab, encoding.n_vocab + 1
        self.size = encoding.n_vocab + 2
        own = [encoding.encode_ordinary(" " + w.decode("utf-8")) for w in words]
        own.append([self.rare])  # the last place, which -1 means too
        self.sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.fromiter((x for ids in own for x in ids), dtype=np.int32, count=int(self.sizes.sum()))

    def text(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end, first id's place of each word and of the end) of words by their places, -1 for rare ones."""
        sizes = self.sizes[places]
        firsts = np.zeros(len(places) + 1, dtype=np.int64)
        np.cumsum(sizes, out=firsts[1:])
        at = np.repeat(self.first[places] - firsts[:-1], sizes)
        at += np.arange(len(at))
        ids = np.full(len(at) + 1, self.end, dtype=np.int32)
        np.take(self.flat, at, out=ids[:-1])
        return ids, firsts

    def counts(self, counts: np.ndarray) -> np.ndarray:
        """How often each id occurs where the words occur so often."""
        whole = np.r_[counts, 0]
        return np.bincount(self.flat, weights=np.repeat(whole, self.sizes), minlength=self.size)


def words_of(body: bytes) -> list[bytes]:
    """Between ASCII white space, A-Z lowered."""
    return body.lower().split()


def places_of(words: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    """Of words by a table; -1 for those that it lacks."""
    return np.fromiter(map(place.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def propose(docs: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The words that occur most often in docs (body binary), `most` of them at most, each with how often it occurs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for x in batch.column(0):
                c.update(words_of(x.as_py()))
                if len(c) >= DISTINCT:
                    yield found()
                    c.clear()
        yield found()

    counted = docs.mapInArrow(scan, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [(bytes(r["word"]), r["n"]) for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]  # `most` words


POSTINGS = "word binary, did long, th long, tf int, train boolean"


def _postings(frequent):
    """Postings of the words that are not frequent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frozenset(frequent.value).__contains__
        for batch in batches:
            did, th, train = (batch.column(k) for k in (0, 1, 3))
            words, rows, tfs = [], [], []
            for k, x in enumerate(batch.column(2)):
                c = Counter(filterfalse(often, words_of(x.as_py())))
                words += c
                tfs += c.values()
                rows += [k] * len(c)
                if len(words) > 1 << 17:
                    yield batch_of(words, rows, tfs, did, th, train)
                    words, rows, tfs = [], [], []
            yield batch_of(words, rows, tfs, did, th, train)

    def batch_of(words, rows, tfs, did, th, train) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), did.take(at), th.take(at), pa.array(tfs, pa.int32()), train.take(at)], names=["word", "did", "th", "tf", "train"])

    return scan


#: kind 0: a document's rare words (a did, b th, n known, x sum of log10(count + 1)); 1: distinct words (n) and tokens (a) counted.
COUNTED = "kind int, a long, b long, n long, x double"


def _count():
    """Counts of whole words from postings sorted by word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = total = 0
        kept: pa.Table | None = None

        def rows(kind: int, **columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "x": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32))] + [pa.array(columns[k], v) if k in columns else pa.nulls(n, v) for k, v in kinds.items()], names=["kind", *kinds])

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal distinct, total
            word = t.column("word").combine_chunks()
            new = _starts(word)
            tf, train = np.asarray(t.column("tf")).astype(np.int64), np.asarray(t.column("train"))
            counts = np.add.reduceat(np.where(train, tf, 0), new)
            distinct += int((counts > 0).sum())
            total += int(counts.sum())
            each = np.repeat(counts, np.diff(np.r_[new, len(tf)]))
            use = each > 0
            if use.any():
                did, th = (np.asarray(t.column(k).filter(pa.array(use))) for k in ("did", "th"))
                order = np.lexsort((th, did))
                did, th, tf, lg = did[order], th[order], tf[use][order], (tf[use] * np.log10(each[use] + 1.0))[order]
                at = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (th[1:] != th[:-1])])
                yield rows(0, a=did[at], b=th[at], n=np.add.reduceat(tf, at), x=np.add.reduceat(lg, at))

        for batch in batches:
            t = pa.Table.from_batches([batch])
            kept = t if kept is None else pa.concat_tables([kept, t])
            if kept.num_rows < 1 << 18:
                continue
            kept = kept.combine_chunks()
            cut = int(_starts(kept.column("word").combine_chunks())[-1])
            if cut:
                yield from whole(kept.slice(0, cut))
                kept = kept.slice(cut)
        if kept is not None and kept.num_rows:
            yield from whole(kept)
        yield rows(1, n=np.array([distinct]), a=np.array([total]))

    return scan


def _starts(word: pa.Array) -> np.ndarray:
    """Where a new word begins in a sorted array."""
    import pyarrow.compute as pc

    if len(word) < 2:
        return np.zeros(min(1, len(word)), dtype=np.int64)
    return np.r_[0, np.flatnonzero(np.asarray(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)))) + 1]


@dataclass
class Model:
    """tokens, distinct: of the training side; rare_mass: sum of count + 1 over its words that are not in `words`, plus 1 for unknown ones."""

    path: str
    tokens: int
    distinct: int
    end_count: int
    rare_count: int
    rare_mass: int
    words: list[bytes]
    counts: np.ndarray
    attention: Attention | None = None
    subwords: Subwords | None = None

    def start(self) -> None:
        """An untrained attention model over the ids of the counted words: it predicts their unigram."""
        self.subwords = Subwords(self.path, self.words)
        ids = self.subwords.counts(self.counts)
        ids[self.subwords.end], ids[self.subwords.rare] = self.end_count + 1, self.rare_count + 1
        ids[np.unique(self.subwords.flat)] += 1
        self.attention = Attention(ids)

    def prepare(self) -> None:
        """What workers make for themselves."""
        self.place = {w: k for k, w in enumerate(self.words)}
        self.logs = np.r_[np.log10(self.counts + 1.0), 0.0]  # the last place: rare words
        whole = float(self.counts.sum() + self.end_count + self.rare_count) + 1.0
        self.unigram = np.r_[self.counts, self.rare_count + 1.0] / whole
        self.end_unigram = self.end_count / whole

    def places(self, words: list[bytes]) -> np.ndarray:
        """Of words in `words`; -1 for rare ones."""
        return places_of(words, self.place)

    def word_logs(self, texts: list[np.ndarray]) -> np.ndarray:
        """The attention model's natural log probability of each word ("a rare word" for those) and of the end, for texts as places of words, end to end."""
        cut = [self.subwords.text(x) for x in texts]
        sizes = np.array([len(ids) for ids, _ in cut])
        firsts = np.concatenate([f + b for (_, f), b in zip(cut, (np.cumsum(sizes) - sizes).tolist(), strict=True)])
        return np.add.reduceat(self.attention.score([ids for ids, _ in cut]).astype(np.float64), firsts)

    def mixed(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The natural log probability of every word and end under each of MIXES."""
        a = np.exp(np.minimum(self.word_logs(texts), 0.0)).astype(np.float32)
        u = np.concatenate([np.append(self.unigram[x], self.end_unigram) for x in texts]).astype(np.float32)
        return [np.log(np.maximum(np.float32(m) * u + np.float32(1 - m) * a, TINY)) for m in MIXES]


# ---- training


def _windows(path: str, shared, ready=None, short: bool = False):
    """Windows of ids of whole training texts, each id among the last STRIDE of one of them, and hashes that deal them.

    ready: the words' Subwords, if made. short: ids of two bytes (they must be below SHORT_NONE) instead of four.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        subwords, place = ready.value if ready else Subwords(path, words), {w: k for k, w in enumerate(words)}

        def cut(texts: list[np.ndarray], ths: list[int]) -> pa.RecordBatch:
            lines, _ = laid_out(texts)
            counts = np.array([-(-len(x) // STRIDE) for x in texts], dtype=np.int64)
            with np.errstate(over="ignore"):
                h = lines.astype(np.int64).view(np.uint64) @ DEAL + np.repeat(np.array(ths, dtype=np.int64).view(np.uint64), counts) + np.arange(len(lines), dtype=np.uint64) * DEAL[0]
                h = (h ^ (h >> np.uint64(29))) * DEAL[1]
            kind = np.dtype("<u2" if short else "<i4")
            ends = np.arange(len(lines) + 1, dtype=np.int32) * np.int32(kind.itemsize * lines.shape[1])
            ids = pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(lines.astype(kind)))])  # NONE wraps to SHORT_NONE
            return pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(1)).view(np.int64)), ids], names=["h", "ids"])

        for batch in batches:
            texts, ths, size = [], [], 0
            for th, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.append(subwords.text(places_of(words_of(body.as_py()), place))[0])
                ths.append(th)
                size += len(texts[-1])
                if size >= 8 * HELD:
                    yield cut(texts, ths)
                    texts, ths, size = [], [], 0
            if texts:
                yield cut(texts, ths)
        release()

    return scan


def _lines(ids: list[bytes]) -> np.ndarray:
    """Windows as _windows() writes them, in either width."""
    if len(ids[0]) == 4 * (WINDOW + 1):
        return np.frombuffer(b"".join(ids), dtype="<i4").reshape(-1, WINDOW + 1)
    lines = np.frombuffer(b"".join(ids), dtype="<u2").astype(np.int32).reshape(-1, WINDOW + 1)
    lines[lines == SHORT_NONE] = NONE
    return lines


PARTS = "block long, part int, weight long, numbers binary"


def _packed(model: Attention) -> np.ndarray:
    return np.concatenate([model.p[k].ravel() for k in sorted(model.p)])


def _unpack(model: Attention, flat: np.ndarray) -> None:
    at = 0
    for k in sorted(model.p):
        size = model.p[k].size
        model.p[k] = flat[at : at + size].reshape(model.p[k].shape).astype(np.float32)
        at += size


def _trained(shared, round_: int):
    """One block's windows to its model, in parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = copy.deepcopy(shared.value)
        block = int(pdf["block"].iloc[0])
        lines = _lines(pdf["ids"].tolist())
        with np.errstate(over="ignore"):
            other = lines.astype(np.int64).view(np.uint64) @ DEAL[::-1]  # for the order of windows whose h clash
        lines = lines[np.lexsort((other, pdf["h"].to_numpy()))]
        model.train(lines, max(STEPS, -(-LEARNING * len(lines) // BATCH)), BATCH, seed=1000 * round_ + block % 1000, rate=0.08 / (1 + round_))
        flat = _packed(model).astype("<f4")
        parts = [flat[k : k + PART].tobytes() for k in range(0, len(flat), PART)]
        release()
        return pd.DataFrame({"block": block, "part": range(len(parts)), "weight": len(pdf), "numbers": parts})

    return run


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    weight = pdf["weight"].to_numpy(dtype=np.float64)
    total = sum(w * np.frombuffer(x, dtype="<f4") for w, x in zip(weight, pdf["numbers"], strict=True)) / weight.sum()
    return pd.DataFrame({"block": [pdf["block"].iloc[0] // FAN], "part": [pdf["part"].iloc[0]], "weight": [int(weight.sum())], "numbers": [total.astype("<f4").tobytes()]})


def train(model: Attention, windows: DataFrame) -> Attention:
    """The model after ROUNDS over the windows (h long, ids binary; written): blocks train on their own, their models are averaged up a tree.

    A block belongs to one round, so every window is learned from once; where there are fewer blocks than rounds, to each.
    """
    spark = windows.sparkSession
    count = windows.count()
    if not count:
        return model
    blocks = -(-count // BLOCK)
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("h", "ids"), F.lit(blocks)))
    for round_ in range(ROUNDS):
        own = dealt if blocks < ROUNDS else dealt.where(F.pmod("block", F.lit(ROUNDS)) == round_)
        found = own.groupBy("block").applyInPandas(_trained(spark.sparkContext.broadcast(model), round_), PARTS)
        left = blocks
        while left > 1:
            found = found.groupBy("part", F.expr(f"block div {FAN}")).applyInPandas(_averaged, PARTS)
            left = -(-left // FAN)
        parts = sorted((r["part"], bytes(r["numbers"])) for r in written(found.select("part", "numbers"), "model").collect())  # one model
        model = copy.deepcopy(model)
        _unpack(model, np.frombuffer(b"".join(x for _, x in parts), dtype="<f4"))
        del own, found
        forget(spark)  # a round's windows and models
    return model


# ---- scoring

SCORED = "did long, th long, doc_id_null boolean, held_out boolean, n_tokens long, known long, n_rare long, logs double, scores array<double>"


def _score(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        if not hasattr(model, "place"):
            model.prepare()
        logs = model.logs
        ln10 = np.log(10)
        end_known, end_log = int(model.end_count > 0), float(np.log10(model.end_count + 1.0))
        for batch in batches:
            n_tokens, known, rare, sums, scores = [], [], [], [], []
            held: list[np.ndarray] = []
            size = 0

            def flush(held: list[np.ndarray]) -> None:
                if held:
                    sizes = np.array([len(x) + 1 for x in held])
                    begin = np.cumsum(sizes) - sizes
                    scores.extend(np.stack([np.add.reduceat(x, begin, dtype=np.float64) / ln10 for x in model.mixed(held)], axis=1).tolist())

            for x in batch.column(2):
                words = words_of(x.as_py())
                at = model.places(words)
                log = logs[at]
                n_tokens.append(len(words) + 1)
                known.append(int((log > 0).sum()) + end_known)
                rare.append(int((at < 0).sum()))
                sums.append(float(log.sum()) + end_log)
                held.append(at)
                size += len(words)
                if size >= HELD:
                    flush(held)
                    held, size = [], 0
            flush(held)
            release()
            found = [pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(rare, pa.int64()), pa.array(sums, pa.float64()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(3), *found], names=[f.split()[0] for f in SCORED.split(", ")])

    return scan


def score_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Tokens are words and one end for every text; null counts as empty, an empty text is its end alone. Learns from rows
    that are not held out: counts, frequent words, the attention model and the mixture's weight, each from whole texts. Rows that repeat an id and a text get equal results, and each counts in training. A null id is not held out. Other
    columns are left out, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or tokenizer_path()
    body = F.encode(text_of(text_col), "UTF-8")
    rows = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("did"), F.xxhash64(body).alias("th"), body.alias("body"), held_out(id_col).alias("held_out"), F.col(id_col).isNull().alias("doc_id_null"))
    learning = rows.where(~F.col("held_out"))
    end_count = learning.count()
    proposed = propose(learning.select("body"), frequent)
    words, counts = [w for w, _ in proposed], np.array([n for _, n in proposed], dtype=np.int64)
    shared_words = spark.sparkContext.broadcast(words)
    postings = rows.select("did", "th", "body", (~F.col("held_out")).alias("train")).mapInArrow(_postings(shared_words), POSTINGS)
    dealt = postings.repartition(partitions(spark), "word").sortWithinPartitions("word")
    counted = written(dealt.mapInArrow(_count(), COUNTED), "counted")
    rare_distinct, rare_count = counted.where("kind = 1").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))).first()
    tokens = int(counts.sum()) + rare_count + end_count
    model = Model(path, tokens, len(words) + rare_distinct + (end_count > 0), end_count, rare_count, rare_count + rare_distinct + 1, words, counts)
    model.start()
    forget(spark)  # postings
    since = mark()
    short = model.subwords.size < SHORT_NONE
    cut = _windows(path, shared_words, spark.sparkContext.broadcast(model.subwords), short)
    model.attention = train(model.attention, written(learning.select("th", "body").mapInArrow(cut, "h long, ids binary"), "windows"))
    sweep(spark, since)
    scored = written(rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), SCORED), "scored")
    totals = scored.where(~F.col("held_out")).agg(*[F.sum(F.get("scores", F.lit(k))).alias(f"m{k}") for k in range(len(MIXES))]).first()
    best = max(range(len(MIXES)), key=lambda k: (totals[k] if totals[k] is not None else 0.0, -k))
    scored = scored.withColumn("score", F.get("scores", F.lit(best)))
    rare = counted.where("kind = 0").groupBy(F.col("a").alias("did"), F.col("b").alias("th")).agg(F.sum("n").alias("rare_known"), F.sum("x").alias("rare_logs"))
    repeats = rows.groupBy("did", "th").agg(F.count("*").alias("copies")).where("copies > 1")
    full = scored.join(rare, ["did", "th"], "left").join(repeats, ["did", "th"], "left")
    share = F.coalesce("copies", F.lit(1))
    logs = F.col("logs") + F.coalesce(F.col("rare_logs") / share, F.lit(0.0))
    known = F.col("known") + F.coalesce((F.col("rare_known") / share).cast("long"), F.lit(0).cast("long"))
    base = logs - F.col("n_tokens") * float(np.log10(model.tokens + model.distinct + 1.0))
    score = F.col("score") + F.coalesce(F.col("rare_logs") / share, F.lit(0.0)) - F.col("n_rare") * float(np.log10(model.rare_mass))
    return full.select(F.when(~F.col("doc_id_null"), F.col("did")).alias("doc_id"), "held_out", "n_tokens", known.alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
