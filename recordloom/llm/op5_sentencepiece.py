"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary's pieces and scores are used as a unigram model: the ids of a text are the
segmentation with the largest sum of scores (the method's scan is over such sums; the merges of
a BPE model are not a best path, so ids differ from the BPE mode of the same file). Ties go to
longer pieces (the sum of squared lengths), then to a fixed hash of the pieces, and what still ties
(the same pieces in another order) to the longest last piece, read from the end: a rule on sums from
the start of the text, which every chunk knows exactly, so that ids do not depend on chunks.

No piece of the vocabulary has a blank mark after another character, so every segmentation has
a boundary before each run of marks. The parts between these forced boundaries are solved once
each and kept (as are a word and the marks after it, where no piece joins a letter and a mark). A giant document is cut into chunks at any character. The state at a cut is how
far the piece that straddles it reaches beyond, and a chunk is a max-plus transfer matrix from
its entry states to its exit states. The matrices of a document are combined associatively
(neighbours pairwise, in about log2(chunks) rounds), which gives the best sum of every state at
every cut. With these, each chunk tells on its own which entry state each of its exit states comes
from; following that from the end gives each cut its state, and each chunk is then traced back on
its own.

Decoding joins the pieces and byte pieces of the ids and drops the mark that encoding added.

Nulls: a null text is empty; an empty text has no ids. Blank marks in a text itself become
blanks when decoded, as in the library, and count as a round trip. A null doc_id is an id like
any other; repeated rows are encoded alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.encoding import crc32, crc32_join, text_groups
from recordloom.operators.storage import materialize

MARK = "▁"
CHUNK = 1 << 16
#: Parts in a generation; a worker keeps two, and parts used again stay.
KEPT_PARTS = 500_000
#: Below every sum of scores, and far enough from the limits of 64 bits to be added to itself.
NEVER = -(1 << 60)
#: Bits below a score for breaking ties: enough for a part of 1,024 characters.
_TIE_BITS = 22
#: Scores are whole numbers; lower ones count as this. It is still less than any sum of ranked
#: pieces that could stand in one piece's place, so the best path is the same.
LEAST_SCORE = -1_000_000


class Pieces:
    """The vocabulary of a SentencePiece model, read as a unigram model with exact integer scores."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.weights: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.spelled = [b""] * n
        normal = {i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        for i in range(n):
            piece = model.id_to_piece(i)
            if i in normal:
                self.spelled[i] = piece.replace(MARK, " ").encode()
                self.ids[piece] = i
                self.weights[piece] = self._exact(model.get_score(i), piece)
            elif model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.spelled[i] = bytes([value])
        self.unknown = self._exact(LEAST_SCORE - 10, "")
        self.longest = max(map(len, self.ids))
        begun = {p[:k] for p in self.ids for k in range(1, len(p))}
        #: Of each piece and start of a piece: its weight (NEVER if it is no piece), and whether a longer piece starts so.
        self.starts = {p: (self.weights.get(p, NEVER), p in begun) for p in begun | self.ids.keys()}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a blank mark after another character")
        joined = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.marks = "".join(c for c in string.punctuation if c not in joined)  # never after a letter inside a piece
        self.known: dict[str, tuple[bytes, int]] = {}
        self.older: dict[str, tuple[bytes, int]] = {}

    @staticmethod
    def _exact(score: float, piece: str) -> int:
        return (round(max(score, LEAST_SCORE)) << _TIE_BITS) + (len(piece) ** 2 << 8) + (zlib.crc32(piece.encode()) >> 24)

    def _forward(self, text: str, entry: list[int], end: int) -> tuple[list[int], list[int]]:
        """Best sums and last piece starts for every position; entry[i] is the sum of entering at i; pieces start before ``end``."""
        n = len(text)
        best = entry + [NEVER] * (n + 1 - len(entry))  # an entry may lie beyond a short last chunk
        start = [-1] * len(best)
        starts, unknown = self.starts, self.unknown
        for i in range(end):
            here = best[i]
            if here <= NEVER:
                continue
            j = i + 1
            held = starts.get(text[i])
            if (held is None or held[0] == NEVER) and here + unknown > best[j]:
                best[j], start[j] = here + unknown, i
            while held is not None:
                w, longer = held
                if here + w > best[j] and w != NEVER:
                    best[j], start[j] = here + w, i
                if not longer or j == n:
                    break
                j += 1
                held = starts.get(text[i:j])
        return best, start

    def _trace(self, text: str, start: list[int], at: int) -> tuple[list[int], int]:
        """Ids of the path that ends at ``at``, and where it was entered."""
        pieces: list[str] = []
        while start[at] >= 0:
            pieces.append(text[start[at] : at])
            at = start[at]
        ids: list[int] = []
        for piece in reversed(pieces):
            found = self.ids.get(piece)
            ids.extend([found] if found is not None else (self.bytes[b] for b in piece.encode()))
        return ids, at

    def part(self, part: str) -> tuple[bytes, int]:
        """Ids and sum of a part between forced boundaries."""
        found = self.known.get(part)
        if found is None and (found := self.older.pop(part, None)):
            self.known[part] = found
        if found is None:
            word = part.rstrip(self.marks)
            if len(word) < len(part) and word and word[-1].isalpha():  # a boundary before the marks too
                (a, x), (b, y) = self.part(word), self.part(part[len(word) :])
                found = a + b, x + y
            else:
                best, start = self._forward(part, [0], len(part))
                ids, _ = self._trace(part, start, len(part))
                found = np.array(ids, dtype="<u4").tobytes(), best[len(part)]
            self.known[part] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a marked text that starts and ends at forced boundaries."""
        if len(self.known) > KEPT_PARTS:
            self.known, self.older = {}, self.known
        parts = split_parts(text)
        known = self.known
        for p in parts:
            if p not in known:
                self.part(p)
        return b"".join([known[p][0] for p in parts])

    def _cuts(self, text: str, size: int) -> tuple[int, int]:
        """First and last forced boundary of a chunk's own text that entries and exits cannot pass; (-1, -1): none."""
        low = self.longest
        first = next((i for i in range(low, size) if text[i] == MARK != text[i - 1]), -1)
        last = next((i for i in range(size - 1, first, -1) if text[i] == MARK != text[i - 1]), first) if first >= 0 else -1
        return first, last

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best sums from entry states to exit states of a chunk: ``size`` own characters, then what pieces may reach into."""
        k = self.longest
        out = np.full((k, k), NEVER, dtype=np.int64)
        first, last = self._cuts(text, size)
        if first < 0:
            for i in range(k):
                if i >= size:  # the straddling piece passes the whole chunk
                    out[i, i - size] = 0
                    continue
                best, _ = self._forward(text, [NEVER] * i + [0], size)
                for j in range(min(k, len(text) - size + 1)):
                    out[i, j] = best[size + j]
            return out
        middle = sum(self.part(p)[1] for p in split_parts(text[first:last])) if last > first else 0
        tail, _ = self._forward(text[last:], [0], size - last)
        for i in range(k):
            head, _ = self._forward(text[:first], [NEVER] * i + [0], first)
            for j in range(min(k, len(text) - size + 1)):
                if head[first] > NEVER and tail[size - last + j] > NEVER:
                    out[i, j] = head[first] + middle + tail[size - last + j]
        return out

    def entries(self, text: str, size: int, before: list[int]) -> list[int]:
        """The entry state that each exit state comes from, given the best sums of the entry states."""
        k = self.longest
        first, _ = self._cuts(text, size)
        if first >= 0:  # all paths meet there
            _, start = self._forward(text[:first], before, first)
            return [self._trace(text[:first], start, first)[1]] * k
        _, start = self._forward(text, before, size)
        return [self._trace(text, start, size + j)[1] if size + j < len(start) else 0 for j in range(k)]

    def trace_chunk(self, text: str, size: int, before: list[int], leave: int) -> bytes:
        """Ids of a chunk's pieces on the best path to an exit state, given the best sums of the entry states."""
        first, last = self._cuts(text, size)
        if first < 0:
            _, start = self._forward(text, before, size)
            return np.array(self._trace(text, start, size + leave)[0], dtype="<u4").tobytes()
        _, start = self._forward(text[:first], before, first)
        head = np.array(self._trace(text[:first], start, first)[0], dtype="<u4").tobytes()
        _, start = self._forward(text[last:], [0], size - last)
        tail = np.array(self._trace(text[last:], start, size - last + leave)[0], dtype="<u4").tobytes()
        return head + self.encode(text[first:last]) + tail

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the pieces, with the added blank in front."""
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    """One vocabulary for each Python worker."""
    return Pieces(path)


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def split_parts(text: str) -> list[str]:
    """Runs of marks, each with the characters up to the next run."""
    if MARK * 2 not in text and text[:1] == MARK:
        return [MARK + p for p in text[1:].split(MARK)]
    words = text.split(MARK)
    parts, held = [], ""
    for k, word in enumerate(words):
        held += MARK * (k > 0)
        if word:
            parts.append(held + word)
            held = ""
    return parts + [held] if held else parts


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacked matrices, each shifted to a largest sum of 0, which no choice depends on."""
    out = np.empty_like(a)
    for at in range(0, len(a), 1024):
        out[at : at + 1024] = (a[at : at + 1024, :, :, None] + b[at : at + 1024, None, :, :]).max(axis=2)
    return np.maximum(out - out.max(axis=(1, 2), keepdims=True), NEVER)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes, by combining neighbours and scanning the half as many results."""
    n = len(matrices)
    if n == 1:
        return matrices
    half = scan(max_plus(matrices[: n - 1 : 2], matrices[1::2]))
    out = np.empty_like(matrices)
    out[0] = matrices[0]
    out[1::2] = half
    if n > 2:
        out[2::2] = max_plus(half[: (n - 1) // 2], matrices[2::2])
    return out


def cut_sums(matrices: np.ndarray) -> np.ndarray:
    """Best sums from the start of a document to every state at the cut before each of its chunks, each row up to a constant."""
    first = np.full(matrices.shape[1], NEVER, dtype=np.int64)
    first[0] = 0
    return np.concatenate([first[None], scan(matrices)[:-1, 0, :]])


def cut_states(entries: np.ndarray) -> list[int]:
    """The state at each of the n + 1 cuts of a document's n chunks, from the entry state of each exit state of each chunk."""
    cuts = [0]
    for own in entries[::-1]:
        cuts.append(int(own[cuts[-1]]))
    return cuts[::-1]


CODED = "doc_id long, n_pieces long, ids_crc32 long, n_chunks int, round_trip boolean"


def _numbers(held: bytes) -> list[int]:
    return np.frombuffer(held, dtype=np.int64).tolist()


def _decoded(text: str) -> bytes:
    return text.replace(MARK, " ").encode()


def encode_short(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of at most one chunk: one scan, no shuffle."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            doc_ids, texts = batch["doc_id"], batch["text"].to_pylist()
            for first, last in text_groups(texts):
                own = [marked(t or "") for t in texts[first:last]]
                ids = [pieces.encode(t) if t else b"" for t in own]
                trip = [pieces.decode(i) == _decoded(t) for i, t in zip(ids, own, strict=True)]
                arrays = [
                    doc_ids.slice(first, last - first).cast(pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([crc32(i) for i in ids], pa.int64()),
                    pa.array([1] * len(own), pa.int32()),
                    pa.array(trip, pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "n_chunks", "round_trip"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(code, CODED + (", ids binary" if with_ids else ""))


def _chunks(docs: DataFrame, chunk: int, reach: int) -> DataFrame:
    """Chunks of marked texts: their own characters and the ``reach`` next ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = marked(row["text"])
                n = -(-len(text) // chunk)
                for c in range(n):
                    own = text[c * chunk : (c + 1) * chunk]
                    arrays = [pa.array([row["row"]]), pa.array([row["doc_id"]], pa.int64()), pa.array([c], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([text[c * chunk : (c + 1) * chunk + reach]])]
                    yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "chunk", "size", "text"])

    return docs.mapInArrow(cut, "row long, doc_id long, chunk int, size int, text string")


def encode_giants(docs: DataFrame, path: str, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """Documents of several chunks; what meets in one group is a matrix of 2 KB for each chunk of one document."""
    k = vocabulary(path).longest
    reach = k - 1
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    chunks = materialize(_chunks(numbered, chunk, reach), "text-chunks").repartition("row", "chunk")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            made = [pieces.matrix(t, n).tobytes() for t, n in zip(batch["text"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["chunk"], pa.array(made, pa.binary())], ["row", "chunk", "matrix"])

    def stacked(values: pd.Series, *shape: int) -> np.ndarray:
        return np.stack([np.frombuffer(v, dtype=np.int64).reshape(shape) for v in values])

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        found = cut_sums(stacked(group["matrix"], k, k))
        return pd.DataFrame({"row": group["row"].to_numpy(), "chunk": group["chunk"].to_numpy(), "before": [v.tobytes() for v in found]})

    def states(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        cuts = cut_states(stacked(group["entries"], k))
        return pd.DataFrame({"row": group["row"].to_numpy(), "chunk": group["chunk"].to_numpy(), "enter": cuts[:-1], "leave": cuts[1:]})

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("text", "size", "before")]
            made = [np.array(pieces.entries(t, n, _numbers(b)), dtype=np.int64).tobytes() for t, n, b in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["chunk"], pa.array(made, pa.binary())], ["row", "chunk", "entries"])

    matrices = chunks.select("row", "chunk", "size", "text").mapInArrow(transfer, "row long, chunk int, matrix binary")
    before = matrices.groupBy("row").applyInPandas(sums, "row long, chunk int, before binary")
    chunks = materialize(chunks.join(before, ["row", "chunk"]), "chunk-sums").repartition("row", "chunk")
    chosen = chunks.select("row", "chunk", "size", "text", "before").mapInArrow(choose, "row long, chunk int, entries binary")
    paths = chosen.groupBy("row").applyInPandas(states, "row long, chunk int, enter int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            columns = [batch[n].to_pylist() for n in ("text", "size", "before", "enter", "leave")]
            ids = [pieces.trace_chunk(t, n, _numbers(v), b) for t, n, v, _, b in zip(*columns, strict=True)]
            trip = [pieces.decode(i) == _decoded(t[a : n + b] if a < n + b else "") for i, t, n, _, a, b in zip(ids, *columns, strict=True)]
            arrays = [batch["row"], batch["doc_id"], batch["chunk"], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([crc32(i) for i in ids], pa.int64()), pa.array(trip, pa.bool_())]
            names = ["row", "doc_id", "chunk", "n_pieces", "ids_crc32", "round_trip"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "row long, doc_id long, chunk int, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids binary" if with_ids else "")
    traced = chunks.join(paths, ["row", "chunk"]).select("row", "doc_id", "chunk", "size", "text", "before", "enter", "leave").mapInArrow(trace, schema)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        crc = 0
        for r in group.itertuples():
            crc = crc32_join(crc, r.ids_crc32, 4 * r.n_pieces)
        out = {"doc_id": pd.array([group["doc_id"].iloc[0]], dtype="Int64"), "n_pieces": group["n_pieces"].sum(), "ids_crc32": crc, "n_chunks": len(group), "round_trip": group["round_trip"].all()}
        if with_ids:
            out["ids"] = [b"".join(group["ids"])]
        return pd.DataFrame(out)

    return traced.groupBy("row").applyInPandas(join, CODED + (", ids binary" if with_ids else ""))


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_chunks, round_trip [, ids] for each row of ``docs``."""
    giant = F.coalesce(F.char_length("text") >= chunk, F.lit(False))
    return encode_short(docs.filter(~giant), path, with_ids).unionAll(encode_giants(docs.filter(giant), path, chunk, with_ids))


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``ids``; a document without ids is the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            texts = [pieces.decode(i)[1:].decode(errors="replace") for i in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
