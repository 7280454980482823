"""SentencePiece BPE encoding and decoding with a max-plus parallel scan over chunks of documents.

A sequence of pieces is the model's encoding of a text exactly if every two neighbours, taken alone, encode to
themselves. So an encoding is a path of pieces over text positions, on which each step to a compatible piece adds the
piece's score and any other step costs minus infinity: a max-plus product. A document is cut into chunks anywhere. A state at
a cut is the last piece that begins before it, by its ends relative to the cut; a chunk yields the transfer matrix from
the states at its first cut to those at its last one. Matrices are multiplied up a tree of FAN children a node, no task of
which holds a whole document; the root's best path gives the states of its two cuts, and every node hands its children
theirs, down to the chunks, each of which is traced back on its own. No piece joins a character to a meta space after
it, so paths meet at such places: between two of them a segment's matrix has one entry, its path is walked once and
remembered by the segment's text, and a chunk's matrix is the product of its segments'. Documents of one chunk have no cut
and need no tree. The library is asked for the pieces and their scores alone, never for an encoding.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.llm._base import importable, partitions, release, text_of, written

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 15
#: Children of a node of the tree that multiplies a document's matrices.
FAN = 32
#: Pairs of pieces, and segments, that a worker remembers before it lets the older ones go.
REMEMBERED, SEGMENTS = 300_000, 200_000
START = (0, 0)
UNKNOWN = -1


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a BPE model file with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.surface: list[bytes] = []
        for k in range(len(sp)):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.surface.append(b"")
            else:
                self.id[piece], self.score[piece] = k, sp.get_score(k)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.id))
        inside = {c for p in self.id if len(p) > 1 for c in p}
        self.line = "\n" not in inside  # no piece joins a line end to anything
        self.scores = np.array([0.0 if sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) else sp.get_score(k) for k in range(len(sp))])
        self.ends = {p[k:] for p in self.id for k in range(len(p))}  # what a piece can end with
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece joins a character to a meta space after it")
        self.segment = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if self.line else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, bytes] = {}  # ids of segments: those asked for lately, and before
        self.before: dict[str, bytes] = {}
        self.pairs: dict[str, dict] = {}
        self.asked = 0
        self.one = {p: np.array([k], dtype="<i4").tobytes() for p, k in self.id.items()}
        self.own: dict[str, tuple[str, str] | None] = {}
        self.odd: set[str] = set()  # pieces that score higher than a part of theirs, or never come about

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE of a short text by its definition (the best-scored neighbours merge first, the leftmost of equals), and the last merge."""
        parts, split = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            split = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, split

    def halves(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from, None if it never comes about; characters are made of nothing."""
        found = self.own.get(piece)
        if found is None and piece not in self.own:
            parts, split = self.merge(piece)
            found = (split or ("", "")) if parts == [piece] else None
            if found is None or (split and any(self.merged(x) <= self.score[piece] or (len(x) > 1 and (self.halves(x) is None or x in self.odd)) for x in split)):
                self.odd.add(piece)
            self.own[piece] = found
        return found

    def merged(self, piece: str) -> float:
        """When a piece comes about: higher is earlier, characters are there from the start."""
        return self.score[piece] if len(piece) > 1 else np.inf

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b, side by side, encode to themselves. Characters that are no pieces go with anything.

        At every moment of the merges inside a and b, their neighbours at the seam (down a's right side and b's left side) must not
        merge with each other before one of them merges with its own half.
        """
        if a not in self.id or b not in self.id:
            return bool(a) or self.halves(b) is not None
        self.asked += 1
        if self.asked > REMEMBERED:
            self.asked = 0
            self.pairs.clear()
        return self.halves(a) is not None and self.halves(b) is not None and self._seam_holds(a, b)

    def _seam_holds(self, a: str, b: str) -> bool:
        until_a = until_b = -np.inf  # when the neighbours are gone
        whole = [a, b]
        while True:
            s = self.score.get(a + b)
            if s is not None:
                self.halves(a + b)
            if not self.odd.isdisjoint((a, b, a + b)):  # merged out of order: by the definition
                return self.merge("".join(whole))[0] == whole
            if s is not None and s > until_a and s >= until_b:
                return False
            late_a, late_b = self.merged(a), self.merged(b)
            if len(b) > 1 and late_b <= late_a:  # of equals, the left one is merged first
                until_b, b = late_b, self.halves(b)[0]
            elif len(a) > 1:
                until_a, a = late_a, self.halves(a)[1]
            else:
                return True

    def forced(self, left: str, right: str) -> bool:
        """Whether every encoding ends a piece between two characters."""
        return (right == SPACE and left != SPACE) or (self.line and "\n" in (left, right))

    def forward(self, text: str, begin: int, end: int, last: str | None) -> dict[int, tuple[int, str, float]]:
        """The paths from `begin`, after the piece `last`, that step from places before `end`: place -> (place before, piece, score so far).

        One step at most into a place is compatible with the path before it, so the first one found is the best one.
        """
        reached: dict[int, tuple[int, str, float]] = {begin: (-1, last or "", 0.0)}
        ids, ends, scores, longest = self.id, self.ends, self.score, self.longest
        after = {begin: self.after(last or "")}
        for to in range(begin + 1, min(len(text), end + longest - 1) + 1):
            for at in range(min(to, end) - 1, max(begin, to - longest) - 1, -1):
                piece = text[at:to]
                if piece in ids:
                    good = after.get(at)
                    if good is None:
                        continue
                    then = good.get(piece)
                    if then is None:
                        then = good[piece] = self.compatible(reached[at][1], piece) and self.after(piece)
                    if then:
                        reached[to] = (at, piece, reached[at][2] + scores[piece])
                        after[to] = self.after(piece)
                        break
                elif at == to - 1:
                    if at in reached:
                        reached[to] = (at, piece, reached[at][2])
                        after[to] = self.after(piece)
                        break
                elif piece not in ends:
                    break
        return reached

    def after(self, piece: str) -> dict:
        """What is known of the pieces that may follow a piece ("": at a forced place): False, or what is known of their followers."""
        found = self.pairs.get(piece)
        if found is None:
            found = self.pairs[piece] = {None: False}
        return found

    def bytes_of(self, piece: str) -> bytes:
        known = self.one.get(piece)
        return known if known is not None else np.array([self.byte[b] for b in piece.encode("utf-8", "surrogatepass")], dtype="<i4").tobytes()

    def walk(self, reached: dict[int, tuple[int, str, float]], begin: int, at: int) -> list[str]:
        out = []
        while at != begin:
            at, piece, _ = reached[at]
            out.append(piece)
        return out[::-1]

    def segment_ids(self, segment: str) -> bytes:
        """Ids of a text that begins and ends at forced places with none between: forward() from one to the other, traced back."""
        found = self.before.get(segment)
        if found is None:
            ends, ids = self.ends, self.id
            came, pieces, good = [0], [""], [self.after("")]
            for to in range(1, len(segment) + 1):
                at = to - 1
                while True:
                    piece = segment[at:to]
                    then = good[at].get(piece)
                    if then is None:
                        then = good[at][piece] = (self.compatible(pieces[at], piece) if piece in ids else at == to - 1) and self.after(piece)
                    if then:
                        came.append(at)
                        pieces.append(piece)
                        good.append(then)
                        break
                    if not at or piece not in ends:
                        raise ValueError(f"no path into place {to} of {segment!r}")
                    at -= 1
            out, at, one = [], len(segment), self.one
            while at:
                piece = pieces[at]
                out.append(one.get(piece) or self.bytes_of(piece))
                at = came[at]
            found = b"".join(out[::-1])
        if len(self.known) > SEGMENTS:
            self.known, self.before = {}, self.known
        self.known[segment] = found
        return found

    def encode_run(self, text: str) -> tuple[bytes, float]:
        """(ids as little-endian 32-bit, score) of a text that begins and ends at forced places: the product of its segments."""
        get, other = self.known.get, self.segment_ids
        found = b"".join([get(x) or other(x) for x in self.segment.findall(text)])
        return found, float(self.scores[np.frombuffer(found, dtype="<i4")].sum())

    # ---- one chunk of a document: text[begin:end] with what its pieces can reach on either side

    def states(self, text: str, cut: int, begin: int) -> list[tuple[int, int]]:
        """Pieces that begin before a cut and end at or after it, by their ends relative to the cut."""
        out = []
        for i in range(max(begin, cut - self.longest), cut):
            for j in range(cut, min(len(text), i + self.longest) + 1):
                if j - i == 1 or text[i:j] in self.id:
                    out.append((i - cut, j - cut))
        return out

    def places(self, text: str, begin: int, end: int) -> tuple[int, int]:
        """The first and last forced places in [begin, end], or (-1, -1)."""
        first = last = -1
        for k in range(max(1, begin), min(end, len(text) - 1) + 1):
            if self.forced(text[k - 1], text[k]):
                first = k
                break
        if first >= 0:
            for k in range(min(end, len(text) - 1), first - 1, -1):
                if self.forced(text[k - 1], text[k]):
                    last = k
                    break
        return first, last

    def transfer(self, text: str, begin: int, end: int, at_start: bool, at_end: bool) -> dict[tuple[int, int], dict[tuple[int, int], float]]:
        """The chunk's matrix: entry state -> exit state -> score of the pieces that begin inside it."""
        first, last = self.places(text, begin, end)
        middle = None
        out: dict = {}
        for state in [START] if at_start else self.states(text, begin, 0):
            a, b = (begin + state[0], begin + state[1])
            piece = text[a:b] if state != START else None
            if b >= end:  # the piece reaches over the whole chunk; an empty document has no piece at all
                if b == end or not at_end:
                    out[state] = {(a - end, b - end): 0.0}
                continue
            row: dict = {}
            if first >= b:
                head = self.forward(text, b, first, piece)
                if first not in head:
                    continue
                if middle is None:
                    score = self.encode_run(text[first:last])[1]
                    tail = self.forward(text, last, end, None)
                    middle = {k: score + s for k, s in self.exits(tail, last, end, at_end, text).items()}
                    if last == end and not at_end:
                        middle = {}
                before = head[first][2]
                row = {k: before + s for k, s in middle.items()}
                if last == end:  # the cut is a forced place itself
                    row = self._exits_at(text, first, last, head, b, end, piece)
            else:
                row = self.exits(self.forward(text, b, end, piece), b, end, at_end, text)
            if row:
                out[state] = row
        return out

    def _exits_at(self, text: str, first: int, last: int, head: dict, b: int, end: int, piece: str | None) -> dict:
        if first == last:
            at, _, score = head[first]
            return {(at - end, 0): score} if at >= 0 else {}
        k = next((k for k in range(last - 1, first, -1) if self.forced(text[k - 1], text[k])), first)
        at, _, score = self.forward(text, k, last, None)[last]
        return {(at - end, 0): head[first][2] + self.encode_run(text[first:k])[1] + score}

    @staticmethod
    def exits(reached: dict, begin: int, end: int, at_end: bool, text: str) -> dict[tuple[int, int], float]:
        out = {}
        for at, (before, _, score) in reached.items():
            if before >= 0 and before < end <= at and (not at_end or at == end):
                out[before - end, at - end] = score
        return out

    def trace(self, text: str, begin: int, end: int, entry: tuple[int, int], exit_: tuple[int, int]) -> bytes:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        b, stop = begin + entry[1], end + exit_[1]
        if b >= end:
            return b""
        piece = text[begin + entry[0] : b] if entry != START else None
        first, last = self.places(text, b, end)
        if first < 0:
            return b"".join(map(self.bytes_of, self.walk(self.forward(text, b, end, piece), b, stop)))
        head = self.walk(self.forward(text, b, first, piece), b, first)
        tail = self.walk(self.forward(text, last, end, None), last, stop) if stop > last else []
        return b"".join(map(self.bytes_of, head)) + self.encode_run(text[first:last])[0] + b"".join(map(self.bytes_of, tail))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, the dummy prefix included."""
        return b"".join(map(self.surface.__getitem__, ids.tolist()))


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def multiply(a: dict, b: dict) -> dict:
    """The max-plus product of two sparse matrices."""
    out: dict = {}
    for i, row in a.items():
        into: dict = {}
        for k, x in row.items():
            for j, y in b.get(k, {}).items():
                if j not in into or x + y > into[j]:
                    into[j] = x + y
        if into:
            out[i] = into
    return out


def product(matrices: list[dict]) -> dict:
    """The product of neighbouring matrices, multiplied in pairs, then pairs of pairs."""
    while len(matrices) > 1:
        matrices = [multiply(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def best_exit(matrix: dict) -> tuple[tuple[int, int], float]:
    """The last state of a whole document's best path, and its score."""
    row = matrix.get(START)
    if not row:
        raise ValueError("no path through the chunks")
    state = max(row, key=lambda k: (row[k], k))
    return state, row[state]


def inner_states(matrices: list[dict], entry: tuple[int, int], exit_: tuple[int, int]) -> list[tuple[int, int]]:
    """The states at all cuts of neighbouring matrices, both ends included, on the best path between two states."""
    reached = [{entry: 0.0}]
    for m in matrices:
        reached.append(multiply({entry: reached[-1]}, m)[entry])
    states = [exit_]
    for m, row in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        come = {k: x + m[k][states[-1]] for k, x in row.items() if states[-1] in m.get(k, {})}
        states.append(max(come, key=lambda k: (come[k], k)))
    return states[::-1]


_ZEROS: list[list[int]] = []


def _times(matrix: list[int], v: int) -> int:
    out = k = 0
    while v:
        if v & 1:
            out ^= matrix[k]
        v >>= 1
        k += 1
    return out


def crc_combine(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings laid end to end, from their crcs and the second's length."""
    if not _ZEROS:
        zero = [0xEDB88320, *[1 << k for k in range(31)]]  # one zero bit
        for _ in range(3):  # one zero byte
            zero = [_times(zero, x) for x in zero]
        for _ in range(63):  # 2, 4, 8 of them and so on
            _ZEROS.append(zero)
            zero = [_times(zero, x) for x in zero]
    for k in range(length.bit_length()):
        if length >> k & 1:
            a = _times(_ZEROS[k], a)
    return a ^ b


def _with_prefix(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


CHUNKS = "row long, chunk int, chunks int, before string, body string, after string"


def chunked(docs: DataFrame, text_col: str, path: str, size: int = CHUNK) -> DataFrame:
    """(row, chunk, chunks, before, body, after) of documents (row long, text): the prefixed text in chunks, with what pieces can reach on either side."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = load(path).longest
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = _with_prefix(value.as_py())
                count = max(1, -(-len(text) // size))
                for k in range(count):
                    a, b = k * size, min(len(text), (k + 1) * size)
                    for column, v in zip(out, (row, k, count, text[max(0, a - reach) : a], text[a:b], text[b : b + reach]), strict=True):
                        column.append(v)
                    held += b - a
                if held > 1 << 22:
                    yield _batch(out, CHUNKS)
                    out, held = [[] for _ in range(6)], 0
            yield _batch(out, CHUNKS)

    return docs.select("row", text_col).mapInArrow(scan, CHUNKS)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


ENCODED = "row long, chunk int, chunks int, ids binary, score double"


def _encode_whole(path: str):
    """Documents of one chunk: the path from START to the end."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            found = [model.encode_run(_with_prefix(x.as_py())) for x in batch.column(1)]
            n = batch.num_rows
            yield _batch([batch.column(0).to_pylist(), [0] * n, [1] * n, [f[0] for f in found], [f[1] for f in found]], ENCODED)
        release()

    return scan


NODES = "row long, node long, matrix binary"
STATES = "row long, node long, a int, b int, c int, d int, score double"


def _matrices(path: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                text, begin = r.before + r.body + r.after, len(r.before)
                out.append(pickle.dumps(model.transfer(text, begin, begin + len(r.body), r.chunk == 0, r.chunk == r.chunks - 1)))
            yield pd.DataFrame({"row": batch["row"], "node": batch["chunk"].astype("int64"), "matrix": out})

    return scan


def _node(pdf: pd.DataFrame) -> pd.DataFrame:
    """The product of one node's children, FAN of them at most."""
    matrices = [pickle.loads(m) for m in pdf.sort_values("node")["matrix"]]
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "node": [pdf["node"].iloc[0] // FAN], "matrix": [pickle.dumps(product(matrices))]})


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [best_exit(pickle.loads(m)) for m in pdf["matrix"]]
        yield pd.DataFrame({"row": pdf["row"], "node": pdf["node"], "a": START[0], "b": START[1], "c": [f[0][0] for f in found], "d": [f[0][1] for f in found], "score": [f[1] for f in found]})


def _children(key: tuple, pdf: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
    """The states of one node's children from its own; the first child carries its score on."""
    pdf = pdf.sort_values("node")
    if not len(pdf):
        return pd.DataFrame({n.split()[0]: [] for n in STATES.split(", ")})
    (a, b, c, d, score) = parent[["a", "b", "c", "d", "score"]].iloc[0]
    states = inner_states([pickle.loads(m) for m in pdf["matrix"]], (int(a), int(b)), (int(c), int(d)))
    n = len(pdf)
    return pd.DataFrame({"row": pdf["row"], "node": pdf["node"], "a": [s[0] for s in states[:n]], "b": [s[1] for s in states[:n]], "c": [s[0] for s in states[1:]], "d": [s[1] for s in states[1:]], "score": [score if k == 0 else 0.0 for k in range(n)]})


def cut_states(matrices: DataFrame, most: int) -> DataFrame:
    """STATES of every chunk from the chunks' matrices (NODES, written); `most`: chunks of a document at most. Two shuffles a level, log(most) levels."""
    levels = [matrices]
    while most > 1:
        above = levels[-1].groupBy("row", F.expr(f"node div {FAN}")).applyInPandas(_node, NODES)
        levels.append(written(above, "products"))
        most = -(-most // FAN)
    states = levels.pop().mapInPandas(_roots, STATES)
    while levels:
        below = levels.pop()
        keyed = below.groupBy("row", F.expr(f"node div {FAN}").alias("up")).cogroup(states.groupBy("row", F.col("node").alias("up")))
        states = written(keyed.applyInPandas(_children, STATES), "states")
    return states


def _trace(path: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(path)
        for batch in batches:
            ids = []
            for r in batch.itertuples():
                text, begin = r.before + r.body + r.after, len(r.before)
                ids.append(model.trace(text, begin, begin + len(r.body), (r.a, r.b), (r.c, r.d)))
            yield pd.DataFrame({"row": batch["row"], "chunk": batch["chunk"], "chunks": batch["chunks"], "ids": ids, "score": batch["score"]})

    return scan


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, size: int = CHUNK) -> DataFrame:
    """(row, chunk, chunks, ids, score) for docs (row long unique, text): the model's ids in order of chunk, little-endian 32-bit.

    A chunk has `size` characters; a document's chunks are scanned and traced in parallel. A document's score, the
    sum of its pieces' scores, stands in its first chunk. Null and empty texts have no ids. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or model_path()
    slim = docs.select("row", text_of(text_col).alias("text"))
    short = slim.where(F.length("text") < size).mapInArrow(_encode_whole(path), ENCODED)
    giant = written(chunked(slim.where(F.length("text") >= size), "text", path, size), "chunks")
    most = giant.agg(F.max("chunks")).first()[0] or 0
    matrices = written(giant.repartition(partitions(spark), "row", "chunk").mapInPandas(_matrices(path), NODES), "matrices")
    fixed = cut_states(matrices, most).withColumnRenamed("node", "chunk")
    traced = giant.join(fixed, ["row", "chunk"]).mapInPandas(_trace(path), ENCODED)
    return short.unionByName(traced)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(row, chunk, chunks, bytes): the UTF-8 of each chunk's ids, without the dummy prefix; chunks of a row laid end to end are its text."""
    importable(encoded.sparkSession)
    path = path or model_path()

    @F.pandas_udf(T.BinaryType())
    def surface(ids: pd.Series, chunk: pd.Series) -> pd.Series:
        model = load(path)
        return pd.Series([model.decode(np.frombuffer(x, dtype="<i4"))[1 if k == 0 else 0 :] for x, k in zip(ids, chunk, strict=True)])

    return encoded.select("row", "chunk", "chunks", surface("ids", "chunk").alias("bytes"))


def coding_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, score, n_bytes, decoded_crc32, text_crc32, chunks), one row per document.

    Ids as little-endian unsigned 32-bit numbers; crcs of chunks are combined, so no document is gathered whole. Null
    counts as empty: no ids, score 0, one chunk. Rows that repeat come back once each; a null id stays null; other columns
    are left out, whatever their names. An empty table gives an empty result. decoded_crc32 equals text_crc32 unless a text holds the meta space itself, which decodes to a blank.
    """
    spark = docs.sparkSession
    importable(spark)
    path = path or model_path()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    encoded = encode(rows, "text", path, size)

    @F.pandas_udf("struct<decoded: long, size: long, ids_crc: long>")
    def digest(ids: pd.Series, chunk: pd.Series) -> pd.DataFrame:
        model = load(path)
        out = []
        for x, k in zip(ids, chunk, strict=True):
            body = model.decode(np.frombuffer(x, dtype="<i4"))[1 if k == 0 else 0 :]
            out.append((zlib.crc32(body), len(body), zlib.crc32(x)))
        return pd.DataFrame(out, columns=["decoded", "size", "ids_crc"])

    parts = written(encoded.withColumn("d", digest("ids", "chunk")).select("row", "chunk", "chunks", "score", (F.length("ids") / 4).cast("long").alias("n"), "d.*"), "encoded")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        ids = text = 0
        for r in pdf.itertuples():
            ids, text = crc_combine(ids, r.ids_crc, 4 * r.n), crc_combine(text, r.decoded, r.size)
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "chunks": [len(pdf)], "score": [pdf["score"].sum()], "n": [pdf["n"].sum()], "decoded": [text], "size": [pdf["size"].sum()], "ids_crc": [ids]})

    one = parts.where("chunks = 1").select("row", "chunks", "score", "n", "decoded", "size", "ids_crc")
    many = parts.where("chunks > 1").groupBy("row").applyInPandas(joined, "row long, chunks int, score double, n long, decoded long, size long, ids_crc long")
    known = rows.select("row", "doc_id", F.length(F.encode("text", "UTF-8")).cast("long").alias("n_bytes"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    return known.join(one.unionByName(many), "row").select("doc_id", F.col("n").alias("n_ids"), F.col("ids_crc").alias("ids_crc32"), "score", "n_bytes", F.col("decoded").alias("decoded_crc32"), "text_crc32", "chunks")
