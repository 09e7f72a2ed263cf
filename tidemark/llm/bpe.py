"""Byte-level BPE encoding and decoding with a pair occurrence index (operator 8).

Texts of a task are taken ``HELD_BYTES`` at a time.  They are cut at spaces,
the pieces are numbered by Arrow's dictionary, and each distinct pretoken of
such a stretch is encoded once; nothing is kept for the next one.  All
pretokens of a stretch are laid out in one symbol array.  An index maps every mergeable pair, by its merge rank, to all its
positions in that array.  Active ranks are applied in ascending order: a
rank merges all its positions at once (vectorised), then the pairs to the
left and right of the merged symbols are looked up and entered in the lists
of their own ranks.  A pair that holds a fresh symbol always has a later
rank than the merge that made the symbol, so each rank is applied once.

The vocabulary file is a parameter and is read in the tasks' own package
folder; nothing of it is broadcast.

Defined results: a null text is the empty text and has no tokens; special
tokens in a text become their own id, as the library does by default; ids
decode to the same bytes, so decoding gives the text back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import chunks

CHUNK_BYTES = 8 << 20
HELD_BYTES = 32 << 20  # of text whose new units are encoded together
SLICE = 1 << 19  # symbols whose first pairs are looked up at once
#: Two white-space characters, or more than these: where none meet, a space always begins a pretoken.
_DOUBLE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{2}"
#: One run of letters, with or without a space before it and one sign after it: one or two pretokens.
_WORD_AND_SIGN = r"^(?P<word> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<sign>[.,;:!?]?)$"
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow in order
    from code point 256.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class _Numbers(dict):
    """Numbers its keys in the order in which they come up."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


_SIGNS = ["", ".", ",", ";", ":", "!", "?"]


class Units(NamedTuple):
    """Distinct units: pieces that may be several pretokens, and whole pretokens."""
    cut: pa.Array
    whole: list[str]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)  # id of each byte
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right = keys >> 20, keys & (1 << 20) - 1
        self.pattern = regex.compile(pattern)
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") \
            if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, -1 where there is none."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each word."""
        count = len(words)
        lens = np.asarray(pc.binary_length(words), dtype=np.int64)
        raw = pa.concat_arrays([words.cast(pa.large_binary())])  # values from the first one on
        begin = int(np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset]) if count else 0
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[begin:begin + int(lens.sum())]
        sym = self.first[data].astype(np.int32)
        n = len(sym)
        if n == 0:
            return np.zeros(0, dtype=np.uint32), lens
        word = np.repeat(np.arange(count, dtype=np.int32), lens)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(lens)
        ends = ends[lens > 0]
        nxt[ends - 1] = n  # n stands for none on the right, -1 on the left
        prv[np.concatenate([[0], ends[:-1]])] = -1
        alive = np.ones(n, dtype=bool)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(pos: np.ndarray) -> None:
            """Index the pairs that begin at ``pos`` (each has a right neighbour)."""
            if not len(pos):
                return
            rank = self.rank_of(sym[pos], sym[nxt[pos]])
            keep = rank >= 0
            pos, rank = pos[keep], rank[keep]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = [0, *cut.tolist()]
            for r, piece in zip(rank[begin].tolist(), np.split(pos, cut), strict=True):
                if r in lists:
                    lists[r].append(piece)
                else:
                    lists[r] = [piece]
                    heapq.heappush(active, r)

        for low in range(0, n, SLICE):
            enter(low + np.flatnonzero(nxt[low:low + SLICE] < n))
        while active:
            r = heapq.heappop(active)
            got = lists.pop(r)
            pos = got[0] if len(got) == 1 else np.concatenate(got)
            a, b = self.left[r], self.right[r]
            pos = pos[alive[pos] & (sym[pos] == a)]
            other = nxt[pos]
            ok = other < n
            pos, other = pos[ok], other[ok]
            pos = pos[sym[other] == b]
            if not len(pos):
                continue
            if len(got) > 1 or a == b:
                pos = np.unique(pos)
            if a == b:
                pos = _leftmost(pos, nxt)
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos] = self.merged[r]
            alive[gone] = False
            nxt[pos] = after
            has = after < n
            prv[after[has]] = pos[has]
            before = prv[pos]
            enter(np.concatenate([before[before >= 0], pos[has]]) if a != b
                  else np.unique(np.concatenate([before[before >= 0], pos[has]])))
        return sym[alive].astype(np.uint32), np.bincount(word[alive], minlength=count)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        return list(self.encode_texts(pa.array(texts, pa.string())))

    def encode_texts(self, texts: pa.Array):
        """Ids of each text (null: none), one after the other."""
        numbers, units = self._numbered(pc.fill_null(texts.cast(pa.string()), ""))
        flat, starts = self._encode_units(units)
        return (_take(flat, starts, n) for n in numbers)

    def _numbered(self, texts: pa.Array) -> tuple[list[np.ndarray], "Units"]:
        """Numbers of each text's units, and the units.

        Where no two white-space characters meet, a space always begins a
        pretoken, so the text can be cut there.  Other texts, and those with
        special tokens, go through the pattern.
        """
        odd = pc.match_substring_regex(texts, _DOUBLE_SPACE)
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        pieces = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        ends = np.cumsum(np.asarray(pc.list_value_length(pieces), dtype=np.int64))
        coded = pieces.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        bare, place = np.unique(codes[first], return_inverse=True)  # the first piece has no space before it
        codes[first] = len(names) + place
        cut = iter(np.split(codes, ends[:-1])) if len(ends) else iter(())
        own, out = _Numbers(), []
        offset = len(names) + len(bare)
        for is_odd, text in zip(odd.to_pylist(), texts, strict=True):
            if is_odd:
                out.append(np.array([offset + own[w] for w in self._pretokens(text.as_py())], dtype=np.int64))
            else:
                out.append(next(cut))
        spaced = pc.binary_join_element_wise(" ", names, "")
        return out, Units(pa.concat_arrays([spaced, names.take(pa.array(bare))]), list(own))

    def _pretokens(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [w for part in self.special_split.split(text)
                    for w in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def _encode_units(self, units: "Units") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and where each one's begin (and the last one's end)."""
        split = pc.extract_regex(units.cut, _WORD_AND_SIGN)
        simple = np.asarray(split.is_valid())
        fields = split.filter(pa.array(simple))
        word = fields.field("word").dictionary_encode()
        others = _Numbers()
        parts = [[others[w] for w in self.pattern.findall(u)] for u in units.cut.filter(pa.array(~simple)).to_pylist()]
        parts += [[others[w]] for w in units.whole]
        signs = fields.field("sign")
        sign = np.array([others[x] if x else -1 for x in _SIGNS], dtype=np.int64)[
            np.asarray(pc.index_in(signs, pa.array(_SIGNS)))] if len(signs) else np.empty(0, dtype=np.int64)
        known = len(word.dictionary)

        sizes = np.zeros(len(units.cut) + len(units.whole), dtype=np.int64)
        at_simple = np.flatnonzero(simple)
        at_other = np.concatenate([np.flatnonzero(~simple), np.arange(len(units.cut), len(sizes))])
        sizes[at_simple] = 1 + (sign >= 0)
        sizes[at_other] = [len(p) for p in parts]
        ends = np.cumsum(sizes)
        of = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        begin = ends - sizes
        of[begin[at_simple]] = word.indices.to_numpy()
        of[begin[at_simple][sign >= 0] + 1] = known + sign[sign >= 0]
        flat_others = np.array([known + w for p in parts for w in p], dtype=np.int64)
        mine = sizes[at_other]
        of[np.arange(len(flat_others)) + np.repeat(begin[at_other] - (np.cumsum(mine) - mine), mine)] = flat_others

        words = pa.concat_arrays([word.dictionary.cast(pa.string()), pa.array(list(others), pa.string())])
        flat, lens = self.encode_words(words)
        if any(w in self.special for w in others):
            flat, lens = self._with_special(words.to_pylist(), flat, lens)
        starts = np.concatenate([[0], np.cumsum(lens)])
        total = np.concatenate([[0], np.cumsum(lens[of])])
        return _take(flat, starts, of), np.concatenate([[0], total[ends]])

    def _with_special(self, words: list[str], flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Special tokens, encoded like ordinary text so far, become their own id."""
        parts = np.split(flat, np.cumsum(lens)[:-1])
        for i, w in enumerate(words):
            if w in self.special:
                parts[i] = np.array([self.special[w]], dtype=np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that form no UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def _take(flat: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``flat[starts[i]:starts[i + 1]]`` of all i in ``which``, one after another."""
    if not len(which):
        return flat[:0]
    start, lens = starts[which], starts[which + 1] - starts[which]
    ends = np.cumsum(lens)
    return flat[np.arange(ends[-1]) + np.repeat(start - (ends - lens), lens)]


def _leftmost(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of sorted positions of a pair of equal symbols, every other one of each run."""
    follows = np.zeros(len(pos), dtype=bool)
    follows[1:] = nxt[pos[:-1]] == pos[1:]
    run_start = np.flatnonzero(~follows)
    run = np.cumsum(~follows) - 1
    return pos[(np.arange(len(pos)) - run_start[run]) % 2 == 0]


@lru_cache(maxsize=2)
def codec(name: str = VOCABULARY) -> Codec:
    """The codec of a worker process."""
    import public_tokenizers

    return Codec(vocabulary_path(name), public_tokenizers.PATTERN)


def encoded(batches, vocabulary: str = VOCABULARY):
    """(id column, ids of each row) of the batches of a task.

    Up to ``HELD_BYTES`` of text are held and encoded together.
    """
    c = codec(vocabulary)
    held, size = [], 0

    def out():
        rows = iter(c.encode_texts(pa.concat_arrays([texts for _, texts in held])) if held else ())
        for column, texts in held:
            yield column, islice(rows, len(texts))

    for whole in batches:
        for batch in chunks(whole, "text", CHUNK_BYTES):
            texts = batch.column("text").cast(pa.string())
            held.append((batch.column("id"), texts))
            size += pc.sum(pc.binary_length(texts)).as_py() or 0
            if size >= HELD_BYTES:
                yield from out()
                held, size = [], 0
    yield from out()
    del held
    pa.default_memory_pool().release_unused()  # the worker may go on with another operator


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return (docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")),
            docs.schema[id_col].dataType.simpleString())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id and the token ids (array of int) of every row."""
    def run(batches):
        for column, rows in encoded(batches, vocabulary):
            yield pa.RecordBatch.from_arrays(
                [column, pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["id", "ids"])

    pairs, kind = _narrow(docs, id_col, text_col)
    return pairs.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id, number of ids, digest of the ids, digest of the text decoded from them."""
    def run(batches):
        c = codec(vocabulary)
        for column, rows in encoded(batches, vocabulary):
            n, of_ids, of_text = [], [], []
            for ids in rows:
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(c.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    pairs, kind = _narrow(docs, id_col, text_col)
    return pairs.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("id", id_col)
