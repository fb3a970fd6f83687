"""Token ids by the tokenizers library, each distinct word encoded once per task.

A byte-level BPE first splits a text into words (a space goes to what follows) and then merges within each word alone.
The split is done here for many texts at a time in numpy, with the library itself as the judge of what is a letter, a
number or white space; words are told apart by 64-bit hashes, and the library's BPE model gives the ids of new ones.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np

#: Characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: 0xFF is no byte of UTF-8, so it can part words; its character is no byte's.
_BYTE_CHARS = {b: chr(b) if b in _PRINTABLE else chr(256 + sum(x not in _PRINTABLE for x in range(b))) for b in range(255)} | {255: "\n"}
#: Words encoded in one call, and words kept (about 40 bytes each).
_RUN, _KEPT = 16_384, 300_000
_UNKNOWN, _LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3, 4
_APOSTROPHE = ord("'")
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, .. of each (start, length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Encoder:
    """Ids of whole texts, equal to the library's own ``encode(text, add_special_tokens=False).ids``.

    The string of a special token inside a text is that token, as the library has it by default; with
    ``specials_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, specials_as_text: bool = False) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        added = {} if specials_as_text else {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = added
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(_BYTE_CHARS[255])
        self.bytes_of = np.zeros(self.size, np.int64)  # each character of a token stands for one byte
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        self.kind = np.zeros(0x110000, np.uint8)
        self._reset()

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes; beside them the places of their ids
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """Kind of each character; the library is asked once for each that is new."""
        kinds = self.kind[points]
        if not kinds.all():
            alone = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s)) == 1
            for p in np.unique(points[kinds == _UNKNOWN]).tolist():
                self.kind[p] = next((k for k, beside in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if alone(beside + chr(p))), _SPACE)
            kinds = self.kind[points]
        return kinds

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where words begin; ``first`` are the places where texts begin."""
        kind = self._kinds(points)
        begins = np.empty(len(points) + 1, bool)
        begins[0], begins[1:-1], begins[-1] = True, kind[1:] != kind[:-1], True
        head = np.zeros(len(points) + 1, bool)
        head[first] = head[-1] = True
        begins |= head
        # White space before other text leaves its last character to it, if that is a space, or alone.
        last = np.flatnonzero((kind == _SPACE) & begins[1:] & ~head[1:])
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
        # Short forms such as 's at the beginning of a word are words of their own.
        at = np.flatnonzero((points == _APOSTROPHE) & begins[:-1] & ~head[1:])
        if len(at):
            after, then = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
            one = np.isin(after, [ord(c) for c in "stmd"])
            two = ~head[at + 2 - (at + 2 > len(points))] & (((after == ord("r")) & (then == ord("e"))) | ((after == ord("v")) & (then == ord("e"))) | ((after == ord("l")) & (then == ord("l"))))
            for pick, n in ((at[one], 2), (at[two], 3)):
                begins[pick + 1] = False
                begins[pick + n] = True
        return np.flatnonzero(begins[:-1])

    def _hashes(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """64-bit hashes of words: sums of character values times powers, taken from running sums."""
        run = np.zeros(len(points) + 1, np.uint64)
        value = _VALUE[points & 0xFFFF] + (points >> 16).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        np.cumsum(value * _powers(_BASE, len(points)), out=run[1:])
        h = (run[starts + lengths] - run[starts]) * _powers(_INVERSE, len(points))[starts] + lengths.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Ids of new words, in the order of their sorted hashes."""
        flat, lengths = [], []
        for lo in range(0, len(words), _RUN):
            raw = [w.encode() for w in words[lo : lo + _RUN]]
            text = b"\xff".join(raw).decode("latin-1").translate(_BYTE_CHARS)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(r) for r in raw])) + 1
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        flat, lengths = np.concatenate(flat), np.concatenate(lengths)
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.start = np.insert(self.start, place, len(self.flat) + np.cumsum(lengths) - lengths)
        self.length = np.insert(self.length, place, lengths)
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another as uint32, number of ids of each text)."""
        if len(self.known) > _KEPT:
            self._reset()
        if any(s in t for s in self.specials for t in texts):
            return self._with_specials(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        starts = self._starts(points, (ends - sizes)[sizes > 0])
        lengths = np.diff(starts, append=len(points))
        kinds, first, which = np.unique(self._hashes(points, starts, lengths), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, kinds)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != kinds) if len(self.known) else np.arange(len(kinds))
        if len(new):
            begin, end = starts[first[new]], starts[first[new]] + lengths[first[new]]
            self._learn(kinds[new], [whole[a:b] for a, b in zip(begin.tolist(), end.tolist())])
            at = np.searchsorted(self.known, kinds)
        at = at[which]
        n = self.length[at].astype(np.int64)
        ids = self.flat[_ragged(self.start[at], n)]
        upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return ids, np.diff(upto)

    def _with_specials(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut at special tokens, whose ids stand between the ids of the parts."""
        parts, owner, after = [], [], []
        for i, text in enumerate(texts):
            while True:
                cut = min(((at, -len(s), s) for s in self.specials if (at := text.find(s)) >= 0), default=None)
                parts.append(text if cut is None else text[: cut[0]])
                owner.append(i)
                after.append(-1 if cut is None else self.specials[cut[2]])
                if cut is None:
                    break
                text = text[cut[0] - cut[1] :]
        ids, n = self.encode(parts)
        owner, after, ends = np.array(owner), np.array(after), np.cumsum(n)
        real = after >= 0
        return np.insert(ids, ends[real], after[real].astype(np.uint32)), np.bincount(owner, n + real, len(texts)).astype(np.int64)


@contextlib.contextmanager
def encoder(path: str, specials_as_text: bool = False) -> Iterator[Encoder]:
    """An encoder for one task; it goes when the task ends, as idle Python workers keep what they hold."""
    made = Encoder(path, specials_as_text)
    yield made
    made.__dict__.clear()


def text_slices(texts: list[str], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters at most (a single longer text stands alone), to bound memory."""
    out, lo, n = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and n + len(t) > most:
            out.append((lo, i))
            lo, n = i, 0
        n += len(t)
    if texts:
        out.append((lo, len(texts)))
    return out
