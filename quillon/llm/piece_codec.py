"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

The distinct words of a batch lie as one flat array of symbols. In every round each word looks up the ranks of its adjacent
pairs, takes the least one (a segmented minimum), and merges all its leftmost occurrences at once; the array is then compacted.
Words without a pair that is a piece leave. The rounds end when no pair remains.

Merging all occurrences at once is what merging one by one gives, unless a merged piece can take part in a pair of no worse
rank (``ab`` and ``c`` where ``abc`` comes before ``ab``); such pieces are marked when the model is read, and of those only the
leftmost of a word is merged in a round.

Words are cut where no piece of the model holds the two adjacent characters, so that no merge can cross the cut. Ids of words are
remembered by each worker, at most ``memo_entries`` of them; memory is that table and one text.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import map_arrow, table

#: The character that stands for a blank (fixed value of the library).
BLANK = "▁"
MEMO_ENTRIES = 400_000
#: Characters of words that are encoded together.
FLAT_CHARS = 2_000_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """The tables of one model file: symbols, pair ranks, ids, bytes of pieces."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo_entries, self.memo = memo_entries, {}
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path}: only BPE models with plain normalisation and ordinary, control and byte pieces are read")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.byte_ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self._read([(p.piece, i, np.float32(p.score)) for i, p in enumerate(model.pieces) if p.type == _NORMAL])
        shown = [p.piece.replace(BLANK, " ").encode() if p.type == _NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else b"" for p in model.pieces]
        self.plain = np.array([p.type in (_NORMAL, _BYTE) for p in model.pieces])
        self.starts_blank = np.array([p.type == _NORMAL and p.piece.startswith(BLANK) for p in model.pieces])
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        line = "" if "\n" in self.symbol else "\n"
        self.words = re.compile(f"{self._blank_cut(model)}{BLANK}*[^{BLANK}{line}]+|{BLANK}+" + ("|\n+" if line else ""))

    def _blank_cut(self, model) -> str:
        """A pattern that cuts long runs of blanks into the longest piece of blanks, if the rounds would do the same.

        They do if the pieces of two and more blanks have one score, the worst of all, no other piece begins with two blanks, and
        the longest is what becomes of a run of its length: leftmost pairs come first, so the run is eaten from its left.
        """
        pieces = [(p.piece, p.score) for p in model.pieces if p.type == _NORMAL]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in pieces):
            raise ValueError("words end at a blank only if no piece holds a blank after another character")
        scores = {s for p, s in pieces if len(p) > 1 and not p.strip(BLANK)}
        most = max((len(p) for p, _ in pieces if not p.strip(BLANK)), default=1)
        plain = scores == {min(s for _, s in pieces)} and not any(re.match(f"{BLANK}{{2,}}[^{BLANK}]", p) for p, _ in pieces)
        return f"{BLANK}{{{most}}}(?={BLANK})|" if plain and len(self.merge([BLANK * most])[0]) == 1 else ""

    def _read(self, pieces: list[tuple[str, int, np.float32]]) -> None:
        """Symbols are numbered: pieces by their id, other characters above them."""
        n = self.n_pieces = max(i for _, i, _ in pieces) + 1
        ids = {p: i for p, i, _ in pieces}
        order = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces}, reverse=True))}
        rank = {p: order[s] for p, _, s in pieces}
        self.symbol = {p: i for p, i in ids.items() if len(p) == 1}
        self.named = np.arange(n, n + sys.maxunicode + 1, dtype=np.int32)
        self.named[[ord(p) for p in self.symbol]] = list(self.symbol.values())
        risky, keys, ranks, made, touching = set(), [], [], [], set()
        for piece, i in ids.items():
            touching.update(zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if a in ids and b in ids:
                    keys.append(ids[a] * n + ids[b])
                    ranks.append(rank[piece])
                    made.append(i)
                    risky.update(ids[x] for x in (a, b) if len(x) > 1 and rank[x] >= rank[piece])
        by = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[by], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(ranks, np.int32)[by], _NONE)
        self.pair_made = np.append(np.array(made, np.int64)[by], 0)
        self.risky = np.zeros(n, bool)
        self.risky[list(risky)] = True
        held = {c for pair in touching for c in pair if c in self.symbol}
        self.touching = np.sort(np.array([self.symbol[a] * n + self.symbol[b] for a, b in touching if a in held and b in held], np.int64))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of each pair of symbols (no rank where it is not a piece)."""
        key = left * self.n_pieces + right
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _NONE), self.pair_made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges (ids of pieces, or ``n_pieces`` + code point for characters that are none), and the word of each."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, sym = self.n_pieces, self.named[points].astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        known = sym < n
        key = sym[:-1] * n + sym[1:]
        at = np.minimum(np.searchsorted(self.touching, key), len(self.touching) - 1)
        joined = (word[:-1] == word[1:]) & known[:-1] & known[1:] & (self.touching[at] == key)
        part = np.concatenate([[0], np.cumsum(~joined)])  # the cut words, numbered from left to right
        done_sym, done_word, done_at = [], [], []
        at = np.arange(len(sym))
        rank, made = self._pairs(sym[:-1], sym[1:])
        rank = np.append(np.where(joined, rank, _NONE), _NONE)
        made = np.append(made, 0)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            least = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(sym)))
            live = np.repeat(least != _NONE, width)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                done_at.append(at[~live])
                sym, word, part, at, rank, made = (x[live] for x in (sym, word, part, at, rank, made))
                least, width = least[least != _NONE], width[least != _NONE]
                if not len(sym):
                    break
            best = np.flatnonzero(rank == np.repeat(least, width))
            # leftmost of overlapping ones: every second of a chain of neighbours; for pieces that may go on at once, the first of the word
            chain = np.concatenate([[True], (best[1:] != best[:-1] + 1) | (part[best[1:]] != part[best[:-1]])])
            offset = np.arange(len(best)) - np.maximum.accumulate(np.where(chain, np.arange(len(best)), 0))
            lead = np.concatenate([[True], part[best[1:]] != part[best[:-1]]])
            word_risky = np.logical_or.reduceat(self.risky[made[best]], np.flatnonzero(lead))[np.cumsum(lead) - 1]
            best = best[np.where(word_risky, lead, offset % 2 == 0)]
            sym[best] = made[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[best] = True
            sym, word, part, at, rank, made, changed = (x[keep] for x in (sym, word, part, at, rank, made, changed))
            changed[:-1] |= changed[1:]
            changed[-1] = False
            look = np.flatnonzero(changed)
            new_rank, new_made = self._pairs(sym[look], sym[look + 1])
            rank[look] = np.where(part[look] == part[look + 1], new_rank, _NONE)
            made[look] = new_made
            rank[-1] = _NONE
        sym, word, at = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_sym, done_word, done_at))
        order = np.argsort(at)
        return sym[order], word[order]

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes, or the unknown id where the model has none."""
        n, out = self.n_pieces, np.flatnonzero(sym >= self.n_pieces)
        if not len(out):
            return sym, word
        spelt = [[self.byte_ids[f"<0x{b:02X}>"] for b in chr(c).encode()] if self.byte_ids else [self.unknown] for c in (sym[out] - n).tolist()]
        size = np.ones(len(sym), np.int64)
        size[out] = [len(x) for x in spelt]
        ids, first = np.repeat(sym, size), np.cumsum(size) - size
        rest = [i for x in spelt for i in x]
        spots = np.repeat(first[out], size[out]) + np.arange(len(rest)) - np.repeat(np.cumsum(size[out]) - size[out], size[out])
        ids[spots] = rest
        return ids, np.repeat(word, size)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of words into the table, some million characters at a time."""
        start, chars = 0, 0
        for k, w in enumerate(words):
            chars += len(w)
            if chars >= FLAT_CHARS or k == len(words) - 1:
                some = words[start : k + 1]
                ids, word = self._with_bytes(*self.merge(some))
                raw = ids.astype("<u4").tobytes()
                ends = (4 * np.searchsorted(word, np.arange(len(some)), "right")).tolist()
                self.memo.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
                start, chars = k + 1, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end id, as little-endian unsigned 32-bit integers."""
        split = [self.words.findall(self.prefix + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = {w for words in split for w in words if w not in self.memo}
        if len(self.memo) + len(new) > self.memo_entries:
            self.memo.clear()
            new = {w for words in split for w in words}
        self._learn(list(new))
        begin, end = (np.array([x], "<u4").tobytes() if x >= 0 else b"" for x in (self.begin, self.end))
        memo = self.memo
        return [begin + b"".join(map(memo.__getitem__, words)) + end for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, as the library's ``decode`` gives it."""
        if ((ids >= len(self.plain)) | (ids == self.unknown)).any():
            return self.library.decode(ids.tolist())
        held = ids[self.plain[ids]]
        start, size = self.shown_at[held], self.shown_at[held + 1] - self.shown_at[held]
        end = np.cumsum(size)
        raw = self.shown[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        drop = bool(self.prefix) and len(held) > 0 and bool(self.starts_blank[held[0]])
        try:
            return raw[int(drop) :].tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no text
            return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def load(path: str, memo_entries: int = MEMO_ENTRIES) -> PieceModel:
    return PieceModel(path, memo_entries)


def encode_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_path: str | None = None,
    memo_entries: int = MEMO_ENTRIES,
    with_ids: bool = False,
) -> DataFrame:
    """Per document row ``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``with_ids`` also ``ids`` and ``decoded``.

    Ids are those of the library with begin and end id, the decoded text is that of its ``decode``. Null and empty texts are the
    two outer ids and decode to an empty text. Very long texts are encoded whole, a text at a time, also where they have no
    blanks. Repeated rows each get their row, so there are no ties; other columns are ignored; an empty table gives no rows.
    """
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, memo_entries)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and chars < FLAT_CHARS:
                    chars += len(texts[end] or "")
                    end += 1
                encoded = model.encode([t or "" for t in texts[at:end]])
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in encoded]
                decoded = [model.decode(x) for x in ids]
                columns = [
                    batch.column(0).slice(at, end - at),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = end

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
