"""Token ids and character offsets of whole texts, with a bounded memory of pieces.

A byte-level BPE never merges across its pre-tokens, and a single blank before a
non-blank always starts one. Texts are therefore cut at such blanks (and around
single line feeds), and every distinct piece is encoded once while it is remembered.
The ids are those of the whole text; tests hold them against the library's own.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from logloom.llm.text import keep_only, release

#: Pieces remembered by a Python worker, in two generations; the older one is forgotten.
MEMORY = 1_000_000
#: Pieces that are encoded as one text.
ROW = 1000
#: Characters of the texts that are numbered together.
AT_ONCE = 1 << 21


class Pieces:
    def __init__(self, path: str, memory: int = MEMORY, offsets: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Only where the claim above holds; other tokenizers take whole texts.
        self.cuts = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and spec.get("truncation") is None
        )
        self.memory, self.offsets = memory, offsets
        #: By piece, and by piece without the blank before it; two generations of each.
        self.young: list[dict[str, bytes]] = [{}, {}]
        self.old: list[dict[str, bytes]] = [{}, {}]
        self.feed = self._packed(self._plain(["\n"])[0])

    def _plain(self, texts: list[str]) -> list:
        encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
        return encode(texts, add_special_tokens=False)

    def _packed(self, encoding) -> bytes:
        """Little-endian 32-bit ids, with `offsets` each followed by its start and end."""
        if not self.offsets:
            return array("I", encoding.ids).tobytes()
        spans = np.array(encoding.offsets, np.uint32).reshape(-1, 2)
        return np.column_stack([np.array(encoding.ids, np.uint32), spans]).astype(np.uint32).tobytes()

    def _learn(self, pieces: set[str], blank: int) -> None:
        """Put the pieces, each with a blank before it if `blank`, into the young generation."""
        young, old, new = self.young[blank], self.old[blank], []
        for p in pieces:
            if p in old:
                young[p] = old[p]
            else:
                new.append(p)
        lead = " " if blank else ""
        if new and self.offsets:
            young.update(zip(new, map(self._packed, self._plain([lead + p for p in new]))))
        elif new:
            # A comma or full stop after a letter is a pre-token of its own.
            bare = {p: p[:-1] for p in new if p[-1:] in (",", ".") and len(p) > 1 and p[-2].isalpha()}
            need = {p for p in new if p not in bare} | {b for b in bare.values() if b not in young}
            ordered = list(need)
            young.update(zip(ordered, map(self._packed, self._plain([lead + p for p in ordered]))))
            if bare:
                marks = {m: self._packed(e) for m, e in zip(",.", self._plain([",", "."]))}
                young.update((p, young[b] + marks[p[-1]]) for p, b in bare.items())

    def _spread(self, packed: list[bytes], lines: list[list[str]]) -> np.ndarray:
        """Rows (id, start, end) of a text: the pieces' own, moved to where the pieces begin."""
        lengths: list[int] = []
        for i, line in enumerate(lines):
            lengths += [1] * (i > 0)
            lengths.append(len(line[0]))
            lengths += [len(p) + 1 for p in line[1:]]
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 12
        base = np.repeat(np.cumsum(lengths) - lengths, sizes).astype(np.uint32)
        rows = np.frombuffer(b"".join(packed), np.uint32).reshape(-1, 3).copy()
        rows[:, 1:] += base[:, None]
        return rows

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text a uint32 array: its ids, or rows (id, start, end) with `offsets`."""
        plain = [self.cuts and "<|" not in t and _single_blanks(t) for t in texts]
        whole = [i for i, p in enumerate(plain) if not p]
        out: list = [None] * len(texts)
        for i, e in zip(whole, self._plain([texts[i] for i in whole]) if whole else []):
            rows = np.frombuffer(self._packed(e), np.uint32)
            out[i] = rows.reshape(-1, 3) if self.offsets else rows
        if sum(map(len, self.young)) > self.memory // 2:
            self.old, self.young = self.young, [{}, {}]
        # What is known is looked up, the rest learned for all texts at once and put in.
        first, rest = (d.get for d in self.young)
        found: list[tuple[int, list[list[str]], list]] = []
        missing: tuple[set[str], set[str]] = (set(), set())
        for i, p in enumerate(plain):
            if p:
                packed: list = []
                lines = [line.split(" ") for line in texts[i].split("\n")]
                for n, line in enumerate(lines):
                    if n:
                        packed.append(self.feed)
                    packed.append(first(line[0]))
                    if packed[-1] is None:
                        missing[0].add(line[0])
                    known = list(map(rest, line[1:]))
                    if None in known:
                        missing[1].update(w for w, k in zip(line[1:], known) if k is None)
                    packed += known
                found.append((i, lines, packed))
        for blank in (0, 1):
            if missing[blank]:
                self._learn(missing[blank], blank)
        for i, lines, packed in found:
            if None in packed:
                packed = []
                for n, line in enumerate(lines):
                    if n:
                        packed.append(self.feed)
                    packed.append(first(line[0]))
                    packed += map(rest, line[1:])
            out[i] = self._spread(packed, lines) if self.offsets else np.frombuffer(b"".join(packed), np.uint32)
        return out


def _single_blanks(text: str) -> bool:
    """White space is single blanks and line feeds between words, and nothing else."""
    words = text.split()
    single = text.count(" ") + text.count("\n")
    return len(words) == single + 1 and sum(map(len, words)) + single == len(text)


#: White space other than blanks and line feeds.
_ODD = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]
_SIDE_BY_SIDE = ["  ", "\n\n", " \n", "\n "]


def _cuttable(text: str) -> bool:
    """_single_blanks() and no special token, found by searching and not by splitting."""
    return bool(text) and not (
        text[0] in " \n" or text[-1] in " \n" or "<|" in text
        or any(x in text for x in _SIDE_BY_SIDE) or any(c in text for c in _ODD)
    )


#: Letters below this one are letters in every version of Unicode.
_NEWER = "\u0250"
#: A byte-level token's characters for the bytes of letters beyond ASCII; the others stand for themselves.
_BYTES = {**{b: 0xA2 + b for b in range(0x80, 0xA1)}, 0xAD: 0x143}


def _letters(piece: str) -> bool:
    """Nothing but letters, so that it is one pre-token with the blank before it."""
    return piece.isalpha() and (piece.isascii() or max(piece) < _NEWER)


def _ranges(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """What `pool` holds of the ranges of these numbers, one after the other."""
    own = sizes[which]
    at = np.repeat(starts[which] - np.cumsum(own) + own, own)
    at += np.arange(len(at))
    return pool[at]


class _Numbers(dict):
    """Numbers of pieces, given in the order in which they come; `met` gets those from `known` on."""

    known = 0

    def __init__(self) -> None:
        super().__init__()
        self.met: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.met.append(piece)
        return number


class Numbered:
    """Token ids of texts from numbered pieces: every piece has its ids in one pool of all.

    Arrow finds the distinct words of a batch of texts, and each of them is looked up once,
    which gives its number; pieces that are new are learned together; and the ids of the whole
    batch are then taken from the pool.
    A piece is a word with the blank before it, which its name leaves out, or with the line
    feed before it, or (marked by HEAD) the first word of a text. At `memory` pieces the
    rarest are forgotten, and learned again if they are met again.
    """

    HEAD = "\r"

    def __init__(self, path: str, memory: int = MEMORY // 2):
        plain = Pieces(path, 0)
        self.tokenizer, self.cuts, self.memory = plain.tokenizer, plain.cuts, memory
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each id's token: a byte-level token has a character for each byte.
        self.widths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.widths[list(vocabulary.values())] = list(map(len, vocabulary))
        self.numbers = _Numbers()
        self.pool, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        #: How often each piece was met, halved whenever some are forgotten.
        self.uses = np.zeros(1 << 12, np.int64)
        #: A comma and a full stop after a letter have pieces of their own.
        self.marks = {m: self.numbers[self.HEAD + m] for m in ",."}
        self._learn()
        # What reading the tokenizer's file took is several times what it is.
        del plain, vocabulary
        release()

    def _forget(self) -> None:
        """Forget the rarest pieces, half of `memory` at least; those kept get new numbers."""
        known, least = self.numbers.known, 2
        while np.count_nonzero(self.uses[:known] >= least) > self.memory // 2:
            least *= 2
        marks = len(self.marks)
        kept = marks + np.flatnonzero(self.uses[marks:known] >= least)
        # Those met most come first and get new names side by side, which the processor's caches hold.
        kept = np.concatenate([np.arange(marks), kept[np.argsort(-self.uses[kept], kind="stable")]])
        ids, sizes, uses = self.taken(kept), self.sizes[kept], self.uses[kept] // 2
        # A number is the place at which its piece was put in; no piece has a blank.
        names = list(self.numbers)
        names = " ".join(map(names.__getitem__, kept.tolist())).split(" ")
        self.numbers = _Numbers()
        self.numbers.update(zip(names, range(len(kept))))
        self.numbers.known = len(kept)
        self.pool, self.used = np.empty(max(1 << 16, len(ids)), np.uint32), 0
        self.uses[:] = 0
        self.uses[: len(kept)] = uses
        self._put(np.arange(len(kept)), ids, sizes)

    def _plain(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """`ids` holds those of one piece after the other."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(ids), self.used), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)

    def taken(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces, one after the other."""
        return _ranges(self.pool, self.starts, self.sizes, numbers)

    def _learn(self) -> None:
        """Give ids to all pieces met since the last time."""
        met, known = self.numbers.met, self.numbers.known
        if not met:
            return
        # Where a comma or full stop follows a letter, the rest is a piece; some are new, too.
        marked = [i for i, p in enumerate(met) if p.endswith((",", ".")) and p[-2:-1].isalpha()]
        bare = [self.numbers[met[i][:-1]] for i in marked]
        mark = [self.marks[met[i][-1]] for i in marked]
        self.numbers.known += len(met)
        self.numbers.met = []
        if self.numbers.known > len(self.starts):
            room = np.empty(self.numbers.known, np.int64)
            self.starts, self.sizes = (np.concatenate([x, room]) for x in (self.starts, self.sizes))
            self.uses = np.concatenate([self.uses, np.zeros(self.numbers.known, np.int64)])
        plain = np.ones(len(met), bool)
        plain[marked] = False
        heads = [i for i in np.flatnonzero(plain).tolist() if met[i][0] == self.HEAD]
        if heads:
            found = [np.array(e.ids, np.uint32) for e in self._plain([met[i][1:] for i in heads])]
            self._put(known + np.array(heads), np.concatenate(found), np.array(list(map(len, found))))
            plain[heads] = False
        letters = np.fromiter(map(_letters, met), bool, len(met)) & plain
        for own, learn in ((letters, self._learn_letters), (plain & ~letters, self._learn_in_a_row)):
            at = np.flatnonzero(own)
            for low in range(0, len(at), ROW):
                few = at[low : low + ROW]
                learn(known + few, [met[i] for i in few.tolist()])
        if marked:
            pairs = np.array([bare, mark]).T
            self._put(known + np.array(marked), self.taken(pairs.ravel()), self.sizes[pairs].sum(axis=1))

    def _learn_letters(self, numbers: np.ndarray, pieces: list[str]) -> None:
        """Words of letters alone: with their blanks they are pre-tokens, which the model takes one by one."""
        row = " ".join(pieces)
        if not row.isascii():
            row = row.encode().decode("latin-1").translate(_BYTES)
        found = [self.model.tokenize("\u0120" + word) for word in row.split(" ")]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((token.id for tokens in found for token in tokens), np.uint32, int(sizes.sum()))
        if self.widths[ids].sum() != len(row) + 1:
            raise ValueError("the bytes of the ids are not those of the pieces")
        self._put(numbers, ids, sizes)

    def _learn_in_a_row(self, numbers: np.ndarray, pieces: list[str]) -> None:
        """Pieces with the blank before them, or that begin with a line feed, encoded as one text.

        The blanks keep them apart, and the widths of the ids tell where each one ends.
        """
        pieces = [p if p[0] == "\n" else " " + p for p in pieces]
        row = "".join(pieces)
        ids = np.array(self._plain([row])[0].ids, np.uint32)
        ends = np.cumsum(self.widths[ids])
        sizes = map(len, pieces if row.isascii() else map(str.encode, pieces))
        stops = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)))
        cuts = np.searchsorted(ends, stops) + 1
        if cuts[-1] != len(ids) or (ends[cuts - 1] != stops).any():
            raise ValueError("ids do not end where the pieces do")
        self._put(numbers, ids, np.diff(cuts, prepend=0))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text a uint32 array of its ids."""
        out, low, held = [], 0, 0
        for high, text in enumerate(texts, 1):
            held += len(text)
            if held >= AT_ONCE or high == len(texts):
                out += self._encode(texts[low:high])
                low, held = high, 0
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.numbers.known > self.memory:
            self._forget()
        out: list = [None] * len(texts)
        cut = [self.cuts and _cuttable(t) for t in texts]
        rest = [i for i, c in enumerate(cut) if not c]
        for i, e in zip(rest, self._plain([texts[i] for i in rest]) if rest else []):
            out[i] = np.array(e.ids, np.uint32)
        lines = [self.HEAD + t.replace("\n", " \n") for t, c in zip(texts, cut) if c]
        if not lines:
            return out
        words = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        # As one text, cut here: no piece has a blank.
        blank = pa.scalar(" ", pa.large_string())
        names = pc.binary_join_element_wise(coded.dictionary, pa.scalar("", pa.large_string()), blank)
        _, bounds, data = names.buffers()
        names = str(data[: np.frombuffer(bounds, np.int64)[len(names)]], "utf-8").split(" ")[:-1]
        met = np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))
        self._learn()
        at = coded.indices.to_numpy()
        self.uses[met] += np.bincount(at, minlength=len(met))
        # The distinct pieces' ids side by side, and from these the texts'.
        pool, sizes = self.taken(met), self.sizes[met]
        ids = _ranges(pool, np.cumsum(sizes) - sizes, sizes, at)
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[words.offsets.to_numpy()]
        parts = iter(np.split(ids, ends[1:-1]))
        for i, c in enumerate(cut):
            if c:
                out[i] = next(parts)
        return out

    def spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the first characters of its tokens, and the characters after their last ones.

        The tokens' bytes tile the text, and a token that begins or ends within a character
        covers all of it. Where this need not hold, the tokenizer is asked.
        """
        own = [self.cuts and "<|" not in t for t in texts]
        found = iter(self.encode([t for t, o in zip(texts, own) if o]))
        rest = [t for t, o in zip(texts, own) if not o]
        asked = iter(self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else [])
        return [
            self._spans(t, next(found)) if o else tuple(np.array(next(asked).offsets, np.int64).reshape(-1, 2).T)
            for t, o in zip(texts, own)
        ]

    def _spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.widths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data) != sizes.sum():
            raise ValueError("the bytes of the ids are not those of the text")
        if len(data) == len(text):
            return starts, ends
        # Up to each byte, the characters that have begun.
        begun = np.cumsum((data & 0xC0) != 0x80)
        return begun[starts] - 1, begun[ends - 1]


@lru_cache(maxsize=1)
def _numbered(path: str) -> Numbered:
    return Numbered(path)


def numbered(path: str) -> Numbered:
    """One per Python worker."""
    keep_only("tokens", _numbered.cache_clear)
    return _numbered(path)
