"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

White space becomes U+2581, one is put before the text, and the text falls into chunks at every place where U+2581 follows
another character; no piece of the vocabulary spans such a place (asserted at load), so merges stay in a chunk and equal chunks
have equal ids. In a chunk, the agenda holds the adjacent pairs that form a piece; the pair of the best score, leftmost on
a tie, is merged and its new neighbours join the agenda. Characters outside the vocabulary become byte pieces.

A worker keeps a bounded table of chunks it has met. Each chunk that enters it is checked, in its Arrow batch, against the
sentencepiece library, both ids and decoded text; if they ever differed, the library's would be taken and counted in
``n_corrected``. One map, no shuffle; whole texts of any length.

Null or empty text: the end id alone, decoded to ''. Each row is handled by itself.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkloom.llm.common import slices

SPACE = "▁"
#: Chunks, of at most so many characters each, that a worker keeps: some 100 MB.
TABLE_CHUNKS, TABLE_CHARS = 600_000, 64
#: Characters up to which a list serves as agenda; rank of a pair that forms no piece.
SHORT, NONE = 40, float("inf")
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.names = [str(i) for i in range(n)]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {v: k for k, v in self.bytes.items()}
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: -lib.get_score(i) for i in plain}
        self.end = lib.eos_id()
        assert len(self.bytes) == 256, "a vocabulary with byte pieces is needed"
        assert not any(SPACE in p.lstrip(SPACE) for p in self.id), "a piece spans a space"
        self.table: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def encode(self, chunk: str) -> list[int]:
        """Ids of a chunk in which spaces are U+2581."""
        whole = self._scan(chunk) if len(chunk) <= SHORT else self._heap(chunk)
        known = self.id.get
        out = [known(s) for s in whole if s]
        if None in out:  # characters outside the vocabulary become bytes
            out = [i for s in whole if s for i in ([known(s)] if s in self.id else [self.byte_id[b] for b in s.encode()])]
        return out

    def _scan(self, chunk: str) -> list[str]:
        """Symbols of a short chunk: the agenda is a list of the adjacent pairs' ranks, in text order."""
        rank, whole = self.rank.get, list(chunk)
        agenda = [rank(a + b, NONE) for a, b in zip(whole, whole[1:])]
        while agenda and (best := min(agenda)) is not NONE:
            i = agenda.index(best)  # the leftmost
            whole[i] += whole.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(whole[i - 1] + whole[i], NONE)
            if i < len(agenda):
                agenda[i] = rank(whole[i] + whole[i + 1], NONE)
        return whole

    def _heap(self, chunk: str) -> list[str]:
        """Symbols of a long chunk, '' where merged away: the agenda is a heap."""
        rank, n = self.rank, len(chunk)
        whole = list(chunk)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (r := rank.get(chunk[i : i + 2])) is not None:
                agenda.append((r, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not whole[left] or not whole[right] or len(whole[left]) + len(whole[right]) != size or after[left] != right:
                continue  # one of the two has been merged meanwhile
            whole[left] += whole[right]
            whole[right] = ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if (r := rank.get(pair := whole[left] + whole[nxt])) is not None:
                    heapq.heappush(agenda, (r, left, nxt, len(pair)))
            if (prev := before[left]) >= 0 and (r := rank.get(pair := whole[prev] + whole[left])) is not None:
                heapq.heappush(agenda, (r, prev, left, len(pair)))
        return whole

    def surface(self, ids: list[int]) -> str:
        """The ids' text, a leading space kept."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.pieces[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def learn(self, chunks: list[str]) -> int:
        """Puts chunks into the table, checked against the library; how many the library had to correct.

        ``odd`` has the decoded text of those that don't decode to themselves.
        """
        plain = [c[1:].replace(SPACE, " ") for c in chunks]
        theirs = self.library.encode(plain, num_threads=1)
        texts = self.library.decode(theirs)
        wrong, pieces, names = 0, self.pieces, self.names
        for c, flat, ids, text in zip(chunks, plain, theirs, texts, strict=True):
            own = self.encode(c)
            # Pieces that spell the chunk decode to it; with byte pieces they don't.
            said = flat if "".join([pieces[i] for i in own]) == c else self.surface(own)[1:]
            # A lone space ends a text; the library has no text that is this chunk only.
            if (own != ids or said != text) and c != SPACE:
                wrong, own, said = wrong + 1, ids, text
            self.table[c] = " ".join([names[i] for i in own])
            if said != flat:
                self.odd[c] = said
        return wrong

    def run(self, texts: list[str | None]) -> tuple[list[str], list[str], list[int]]:
        """Of each text: the ids joined by spaces, with the end id; the decoded text; corrected chunks."""
        split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        table, odd = self.table, self.odd
        if len(table) > TABLE_CHUNKS:
            table.clear()
            odd.clear()
        new = list({c for x in split for c in x if c not in table})
        wrong = self.learn(new)  # for this call all of them, so the table holds TABLE_CHUNKS and a call's chunks at most
        end = [str(self.end)]
        ids = [" ".join([table[c] for c in x] + end) for x in split]
        if odd:
            said = ["".join([" " + odd[c] if c in odd else c.replace(SPACE, " ") for c in x])[1:] for x in split]
        else:
            said = ["".join(x)[1:].replace(SPACE, " ") for x in split]
        for c in new:
            if len(c) > TABLE_CHARS:
                del table[c]
                odd.pop(c, None)
        return ids, said, [wrong] + [0] * (len(texts) - 1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Characters of text that are handled at once.
CALL_CHARS = 4 << 20


def _calls(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t or "") > CALL_CHARS:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    yield start, len(texts)


def encode_decode(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected of each row of ``docs`` (doc_id, text).

    With ``texts`` also the ids (joined by spaces) and the decoded text themselves.
    """
    fields = [docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("n_corrected", LongType())]
    if texts:
        fields += [StructField("ids", StringType()), StructField("decoded", StringType())]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches):
            rows = b.column("text").to_pylist()
            for lo, hi in _calls(rows):
                ids, said, wrong = v.run(rows[lo:hi])
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.array([x.count(" ") + 1 for x in ids], pa.int64()), pa.array([sha256(x.encode()).hexdigest() for x in ids], pa.string())]
                cols += [pa.array([sha256(x.encode()).hexdigest() for x in said], pa.string()), pa.array(wrong, pa.int64())]
                if texts:
                    cols += [pa.array(ids, pa.string()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
