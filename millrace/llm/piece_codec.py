"""Piece encoding with offsets: texts become the ids of a byte-pair piece model, and every id the bytes of the text it is for.

A text is normalised by the longest prefixes that the model's compiled character map knows, then blanks are marked. Both
steps record which stretches they changed, so that a place in what came out leads back to the text. Pieces are merged
within stretches that no piece of the vocabulary reaches beyond; a worker remembers those that it has met.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, map_arrow, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Stretches that a worker remembers, and the longest of them in characters; stretches merged, and characters encoded, at once.
CACHE_STRETCHES, LONGEST = 800_000, 64
TOGETHER, CHARS = 4096, 1 << 20
#: A symbol that was joined to the one before it, or none.
_GONE = -2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Changes:
    """Where a text was changed, in bytes: stretches of the new text and the stretches of the old one they stand for."""

    def __init__(self, new_start, new_end, old_start, old_end):
        self.new_start, self.new_end, self.old_start, self.old_end = (np.asarray(x, np.int64) for x in (new_start, new_end, old_start, old_end))

    def back(self, at: np.ndarray) -> np.ndarray:
        """Places in the old text: a place within a changed stretch is that stretch's start."""
        if not len(self.new_start):
            return at
        k = np.searchsorted(self.new_start, at, side="left") - 1
        after = np.where(at < self.new_end[k], self.old_start[k], self.old_end[k] + at - self.new_end[k])
        return np.where(k < 0, at, after)


def compiled_map(blob: bytes) -> dict[str, str]:
    """The entries of a compiled character map: the size of a double-array trie, its units, then texts that end with NUL."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    value = lambda at: texts[at : texts.index(b"\0", at)].decode()
    step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    found, open_, labels = {}, [(step(int(units[0])), b"")], np.arange(256)
    while open_:
        base, key = open_.pop()
        places = base ^ labels
        inside = places < len(units)
        there = inside & ((units[np.where(inside, places, 0)] & 0x800000FF) == labels) & (labels > 0)
        for label in np.flatnonzero(there):
            unit = int(units[base ^ int(label)])
            name, below = key + bytes([label]), (base ^ int(label)) ^ step(unit)
            if unit & 0x100:
                found[name.decode()] = value(int(units[below]) & 0x7FFFFFFF)
            open_.append((below, name))
    return found


class Normaliser:
    """What a model does to a text before it looks for pieces."""

    def __init__(self, spec):
        self.map = compiled_map(spec.precompiled_charsmap)
        self.longest: dict[str, list[int]] = {}
        for key in self.map:
            self.longest.setdefault(key[0], []).append(len(key))
        for lengths in self.longest.values():
            lengths[:] = sorted(set(lengths), reverse=True)
        self.begins = re.compile(f"[{''.join(map(re.escape, self.longest))}]") if self.map else None
        self.prefix, self.squeeze, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, BLANK if spec.escape_whitespaces else " "

    def mapped(self, text: str) -> tuple[str, Changes]:
        """The longest key of the map at each place is replaced; other characters stay."""
        parts: list[str] = []
        rows: list[tuple[int, int, int, int]] = []
        at = new = old = 0
        m = self.begins.search(text) if self.begins else None
        while m:
            p = m.start()
            key = next((text[p : p + k] for k in self.longest[text[p]] if text[p : p + k] in self.map), None)
            if key is None:
                m = self.begins.search(text, p + 1)
                continue
            stays, put = text[at:p], self.map[key]
            step = len(stays.encode())
            new, old, at = new + step, old + step, p + len(key)
            rows.append((new, new + len(put.encode()), old, old + len(key.encode())))
            new, old = rows[-1][1], rows[-1][3]
            parts += [stays, put]
            m = self.begins.search(text, at)
        return ("".join([*parts, text[at:]]) if parts else text), Changes(*zip(*rows, strict=True)) if rows else Changes([], [], [], [])

    def __call__(self, text: str) -> tuple[str, list[Changes], int]:
        """The normalised text, how to come back from it (last step first), and blanks left out at the start."""
        text, first = self.mapped(text)
        skipped = 0
        if self.squeeze:
            skipped = len(text) - len(text.lstrip(" "))
            text = text.strip(" ")
        if not text:
            return "", [first], skipped
        blank = np.frombuffer(text.encode(), np.uint8) == 0x20
        if self.squeeze:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], blank, [0]))))
            start, end = edges[::2], edges[1::2]
            text = re.sub(" +", " ", text)
        else:
            start = np.flatnonzero(blank)
            end = start + 1
        head, width = len(self.mark.encode()) if self.prefix else 0, len(self.mark.encode())
        new = start + head + np.concatenate(([0], np.cumsum(width - (end - start))))[: len(start)]
        new_start, new_end, old_start, old_end = new, new + width, start, end
        if head:
            new_start, new_end, old_start, old_end = (np.concatenate(([a], b)) for a, b in ((0, new_start), (head, new_end), (0, old_start), (0, old_end)))
        text = text.replace(" ", self.mark)
        return (self.mark + text if head else text), [Changes(new_start, new_end, old_start, old_end), first], skipped


#: Letters with which words are told from what stands around them.
_LETTERS = "A-Za-z\u00c0-\u024f"


def _stretches(pieces: Iterable[str], mark: str) -> str:
    """A pattern of stretches that no piece reaches beyond: marks and what follows up to the next mark; if no piece has one
    of _LETTERS next to another character than a mark, marks and such letters, or marks and other characters, alone."""
    if any(mark in p.lstrip(mark) for p in pieces):
        return "(?s).+"
    letter = re.compile(f"[{_LETTERS}]").match
    if any(bool(letter(a)) != bool(letter(b)) for p in pieces for a, b in pairwise(p.lstrip(mark))):
        return f"{mark}*[^{mark}]+|{mark}+"
    return f"{mark}*(?:[{_LETTERS}]+|[^{mark}{_LETTERS}]+)|{mark}+"


class PieceModel:
    """A byte-pair piece model with bytes for what it doesn't know."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("this is for byte-pair models of plain pieces with bytes for what is unknown")
        self.normalise = Normaliser(model.normalizer_spec)
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == _BYTE}
        self.end = self.library.eos_id()
        mark = self.normalise.mark
        self.stretches = re.compile(_stretches(self.ids, mark))
        self.known: dict[str, tuple[tuple[int, ...], tuple[int, ...], str]] = {}
        self._tables(len(model.pieces))

    def _tables(self, n: int) -> None:
        """Symbols are pieces by their ids, and characters of pieces that are none themselves; pairs make a piece together."""
        symbols = dict(self.ids)
        for char in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            symbols[char] = n + len(symbols) - len(self.ids)
        self.base = n + len(symbols)
        self.of_char = np.full(0x110000, -1, np.int64)
        for symbol, k in symbols.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = k
        pairs = {symbols[p[:c]] * self.base + symbols[p[c:]]: k for p, k in self.ids.items() for c in range(1, len(p)) if p[:c] in symbols and p[c:] in symbols}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], np.int64)
        self.ranks, self.sizes = np.full(n + 1, np.inf), np.zeros(n, np.int64)  # the last rank is that of no piece, -1
        for p, k in self.ids.items():
            self.ranks[k], self.sizes[k] = self.rank[p], len(p.encode())

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols make together, -1 if none."""
        key = np.where((a < 0) | (b < 0), -1, a * self.base + b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def _merge(self, symbol: np.ndarray) -> None:
        """As merged(), for a stretch in each line; the last column is no symbol and stands before the first as well."""
        n, wide = symbol.shape
        after = np.tile(np.arange(1, wide + 1), (n, 1))
        before = after - 2
        made = np.full((n, wide), -1)
        made[:, :-1] = self._joined(symbol[:, :-1], symbol[:, 1:])
        rank, rows = self.ranks[made], np.arange(n)
        while True:
            i = rank[rows].argmin(axis=1)
            live = rank[rows, i] < np.inf
            rows, i = rows[live], i[live]
            if not len(rows):
                return
            j, h, new = after[rows, i], before[rows, i], made[rows, i]
            k = after[rows, j]
            symbol[rows, i], symbol[rows, j], rank[rows, j] = new, _GONE, np.inf
            after[rows, i], before[rows, k] = k, i
            made[rows, i], made[rows, h] = self._joined(new, symbol[rows, k]), self._joined(symbol[rows, h], new)
            rank[rows, i], rank[rows, h] = self.ranks[made[rows, i]], self.ranks[made[rows, h]]

    def learn(self, stretches: list[str]) -> None:
        """Merges short stretches that are new, many at once."""
        stretches.sort(key=len)
        for t in range(0, len(stretches), TOGETHER):
            some = stretches[t : t + TOGETHER]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            inside = np.arange(int(sizes[-1]) + 1) < sizes[:, None]
            codes = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
            symbol = np.full(inside.shape, _GONE)
            symbol[inside] = self.of_char[codes]
            self._merge(symbol)
            there = symbol != _GONE
            odd = (there & ((symbol < 0) | (symbol >= len(self.sizes)))).any(axis=1)
            flat, ends = symbol[there], np.cumsum(there.sum(axis=1)).tolist()
            ids, lengths, begin = flat.tolist(), self.sizes[np.where((flat < 0) | (flat >= len(self.sizes)), 0, flat)].tolist(), 0
            for text, end, strange in zip(some, ends, odd.tolist(), strict=True):
                if strange:
                    self.known[text] = self.stretch(text)
                else:
                    own = tuple(ids[begin:end])
                    self.known[text] = own, tuple(lengths[begin:end]), " ".join(map(str, own))
                begin = end

    def merged(self, text: str) -> list[str]:
        """Pieces of a stretch: of all neighbours that make a piece together, those of the best score are joined, the
        leftmost first, until none are left."""
        n = len(text)
        part, before, after, rank = list(text), list(range(-1, n - 1)), list(range(1, n + 1)), self.rank
        queue = [(rank[text[i : i + 2]], i, 2) for i in range(n - 1) if text[i : i + 2] in rank]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two was joined to another meanwhile
            part[i] += part[j]
            part[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (both := part[a] + part[b]) in rank:
                    heapq.heappush(queue, (rank[both], a, len(both)))
        return [p for p in part if p]

    def stretch(self, text: str) -> tuple[tuple[int, ...], tuple[int, ...], str]:
        """Ids, the bytes of the normalised text that each stands for, and the ids as text."""
        ids, sizes = [], []
        for piece in self.merged(text):
            raw = piece.encode()
            if piece in self.ids:
                ids.append(self.ids[piece])
                sizes.append(len(raw))
            else:  # bytes of one character: the last stands for it
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
        return tuple(ids), tuple(sizes), " ".join(map(str, ids))

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """For each text its ids with the end id, where in the text's bytes each begins and ends, and the ids joined by blanks."""
        plain = [self.normalise(text) for text in texts]
        parted = [self.stretches.findall(p[0]) for p in plain]
        every = set(chain.from_iterable(parted))
        new = [s for s in every if s not in self.known]
        if len(self.known) + len(new) > CACHE_STRETCHES:
            self.known.clear()
            new = list(every)
        self.learn([s for s in new if len(s) <= LONGEST])
        return [self._told(p, s) for p, s in zip(plain, parted, strict=True)]

    def _told(self, plain: tuple[str, list[Changes], int], parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        _, steps, skipped = plain
        known, stretch = self.known, self.stretch
        found = [known.get(s) or stretch(s) for s in parts]
        ids = list(chain.from_iterable([f[0] for f in found]))
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(chain.from_iterable([f[1] for f in found]), np.int64, len(ids)), out=bounds[1:])
        bounds = steps[0].back(bounds) + skipped
        for changes in steps[1:]:
            bounds = changes.back(bounds)
        ids.append(self.end)
        return ids, bounds, np.concatenate((bounds[1:], bounds[-1:])), " ".join([*(f[2] for f in found), str(self.end)])

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        return self.encode_all([text])[0]

    def in_groups(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, str]]:
        """As encode_all, some texts at a time."""
        begin = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= CHARS or k + 1 == len(texts):
                yield from self.encode_all(texts[begin : k + 1])
                begin, size = k + 1, 0


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends, decoded) for each row: ids of its whole text with the end id, the bytes of
    the text that each stands for (the end id for none, at the end; of a character that is written in bytes the last id
    holds it), and the text that the library makes of the ids.

    digest_only: doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of all starts, then all ends, as
    little-endian 64-bit integers) instead. A null text is empty and has the end id alone; rows are encoded one by one, so
    null and repeated ids stay as they are; an empty table gives no rows; texts of any length are encoded whole, in a task.
    Other columns of any name are left out.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            coder = held(f"pieces:{model}", lambda: PieceModel(model))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"] if digest_only else ["n_tokens", "ids", "starts", "ends", "decoded"]
            out: dict[str, list] = {name: [] for name in names}
            for ids, starts, ends, printed in coder.in_groups([text or "" for text in batch.column("text").to_pylist()]):
                decoded = coder.library.decode(ids)
                if digest_only:
                    row = len(ids), hashlib.sha256(printed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(ends.tobytes(), zlib.crc32(starts.tobytes()))
                else:
                    row = len(ids), ids, starts, ends, decoded
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            return out

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long" if digest_only else "n_tokens long, ids array<int>, starts array<long>, ends array<long>, decoded string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, make, schema, keep=["doc_id"])


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), model_path(), digest_only=True)
