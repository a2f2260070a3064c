"""Garbled text from wrong character encoding (problem 8): noisy-channel decoding.

A channel (wrong, right) says that bytes of text in the encoding ``right`` were read as ``wrong``. A stretch of
text goes back to its bytes by ``wrong``; where that loses a byte (a replacement character, a sequence
cut off) a wildcard stands. Out of this lattice of bytes a Viterbi search picks the text in ``right`` that is
most probable under word frequencies of the corpus, with letter pairs for words not among them; a word begun
is worth what all words that begin so are. The stretch is damaged where that text is more probable than the
stretch as it stands by more than damage is rare.

Words are counted over all documents, and all counts take part: each distinct stretch asks for the words that it or
one of its readings is made of, and a join answers with their counts. Only inside the search, where lost bytes are made
up, do the ``TOP_WORDS`` most frequent words stand for all; what it finds is judged by the counts of all words again.
Words that a channel turns into ones far more frequent are taken out before the others are judged, so that damage
which is common is not taken for language. Judgements are made once for each distinct stretch, and summed up for a
document and channel.
"""

from __future__ import annotations

import bisect
import codecs
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfold.operators.skew import HEAVY_SHARE, heavy_keys, split_join
from cairnfold.session import cut, shuffle_width

#: Words that the search for lost bytes knows; what is broadcast has this bound.
TOP_WORDS = 50_000
#: Bytes of damaged stretches that are broadcast to the documents; beyond, these are joined.
BROADCAST_BYTES = 32 << 20
#: Where bytes are lost, longer stretches are searched in pieces of about so many characters, cut between characters.
PIECE = 48
#: A word this many times rarer than its restored form is explained by damage.
RARER = 5
#: Log-odds of a channel for a stretch: UTF-8 has a form that other text hardly takes; other pairs have none.
UTF8_PRIOR, OTHER_PRIOR = -2.5, -4.5
#: Log-odds that a document is damaged.
DOCUMENT_PRIOR = -2.0
#: Nats for a byte that fits no character, and for a sign amid a word.
DROPPED, AMID = 12.0, 8.0
#: Gain of a stretch with control characters that no channel explains.
CONTROL = 8.0

_BYTE = ["latin-1", "cp1252", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp1251", "koi8-r", "cp866", "iso8859-5", "cp437", "cp850", "cp852", "mac-roman"]
_WIDE = ["gbk", "big5", "shift_jis", "euc-jp", "euc-kr"]
_LOST = "�"
#: Signs that stand within words.
_JOINS = "’‘·‐‑"
#: Read as these, UTF-8 comes out wrong; and pairs of other encodings.
CHANNELS = [("utf-16-le", "utf-16-be"), ("latin-1", "utf-16-le"), ("latin-1", "utf-16-be")] + [(w, "utf-8") for w in [*_BYTE, *_WIDE]] + [
    (w, r) for w in ("latin-1", "cp1252", "cp1251", "cp437", "mac-roman", "koi8-r", "cp1250", "cp850", "cp866")
    for r in [*_BYTE, *_WIDE] if w != r
]

_STRETCH = re.compile(r"[^\x00-\x7f]++(?:[A-Za-z]*+[^\x00-\x7f]++)*+[A-Za-z]*+")


#: Bytes of East Asian encodings read one by one: the second of two may be ASCII.
_EASTERN = re.compile(r"(?:[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™][@-~]?){3,}")
#: Printable ASCII in UTF-16 with the bytes of each unit swapped.
_SWAPPED = re.compile("[%s]{3,}" % "".join(chr(b << 8) for b in range(0x20, 0x7F)))
#: The same read byte by byte: every other one is NUL.
_NULLED = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){3,}|(?:\x00[\t\n\r\x20-\x7e]){3,}")
_ODD = re.compile(r"[\x80-\xbfŒŠŸŽƒˆ˜–‚„†‡•‰‹›€™]")


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of letters and characters beyond ASCII with at least one of the latter, whole; and, once more, runs with
    signs in between that may be bytes of two-byte characters, and runs of UTF-16 swapped or read by bytes."""
    for m in _EASTERN.finditer(text):
        own = m.group()
        if not own.isalpha() and len(_ODD.findall(own)) >= 2:
            yield m.span()
    for pattern in (_SWAPPED, _NULLED) if "\0" in text else (_SWAPPED,):
        for m in pattern.finditer(text):
            yield m.span()
    last = 0
    for m in _STRETCH.finditer(text):
        a, b = m.span()
        while a > last and text[a - 1].isascii() and text[a - 1].isalpha():
            a -= 1
        last = b
        yield a, b


@lru_cache(maxsize=None)
def _to_byte(codec: str) -> dict[str, int]:
    """Characters of a single-byte encoding; bytes it leaves open are control characters, as programs do."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


def to_bytes(text: str, codec: str) -> list[int | None] | None:
    """Bytes that were read as ``text``; None for a byte that was lost. None if this text cannot be."""
    out: list[int | None] = []
    if codec == "utf-16-le":
        return list(text.encode(codec, "surrogatepass"))
    if codec in _WIDE:
        for c in text:
            if c == _LOST:
                out.append(None)
                continue
            try:
                out += c.encode(codec)
            except UnicodeError:
                return None
        return out
    table = _to_byte(codec)
    for c in text:
        b = table.get(c)
        if b is None and c != _LOST:
            return None
        out.append(b)
    return out


class Model:
    """Probabilities of text from word frequencies, by letter pairs where words are unknown.

    ``words``: the counts that are looked up; all of them, or those that the text at hand asks for (``asking``).
    ``letters``: counts of letters, of pairs of them, and of words of one character, and the sum of all words' counts.
    """

    def __init__(self, words: dict[str, int], letters: dict[str, dict[str, int] | int] | None = None):
        self.words = words
        letters = letters or letter_counts(words.items())
        self.pairs, self.single, self.alone = letters["pairs"], letters["single"], letters["alone"]
        self.total = max(1, letters["total"])
        own: dict[str, int] = defaultdict(int)  # stretches, and the words in them
        for w, n in words.items():
            for x in set(_words(w)):
                if x and not x.isascii():
                    own[x] += n
        self.skeletons: dict[str, str] = {}
        for w, n in own.items():
            shape = "".join(c if c.isascii() else _LOST for c in w)
            if own.get(self.skeletons.get(shape, ""), 0) < n:
                self.skeletons[shape] = w
        self.starts: dict[str, int] = defaultdict(int)
        for p, n in self.pairs.items():
            self.starts[p[0]] += n
        self.letters = max(1, sum(self.single.values()))
        self.frequent = [c for c, _ in sorted(self.single.items(), key=lambda x: (-x[1], x[0])) if not c.isascii()][:256]
        self._score: dict[str, float] = {}
        self._sorted = sorted(own)
        self._sums = np.r_[0, np.cumsum([own[w] for w in self._sorted], dtype=np.int64)]
        self._begun: dict[str, float] = {}

    def asking(self, words: dict[str, int]) -> None:
        """From here on these are the counts; the search goes on with the words that the model was made of."""
        self.words = words
        self._score = {}

    def count(self, word: str) -> int:
        return self.alone.get(word, 0) if len(word) == 1 else self.words.get(word, 0)

    def begun(self, word: str, logp: float) -> float:
        """Nats of a word that begins so, its letters' pairs having ``logp``."""
        share = self._begun.get(word)
        if share is None:
            a = bisect.bisect_left(self._sorted, word)
            b = bisect.bisect_right(self._sorted, word + "\U0010ffff", a)
            share = self._begun[word] = 0.7 * float(self._sums[b] - self._sums[a]) / self.total
        return -math.log(share + 0.3 * math.exp(max(logp, -700.0)) + 1e-300)

    def ended(self, word: str, logp: float) -> float:
        i = bisect.bisect_left(self._sorted, word)
        own = float(self._sums[i + 1] - self._sums[i]) if i < len(self._sorted) and self._sorted[i] == word else 0.0
        return -math.log(0.7 * own / self.total + 0.3 * math.exp(max(logp, -700.0)) * self.pair(word[-1], "$") + 1e-300)

    def letter(self, c: str) -> float:
        n = self.single.get(c, 0)
        if n:
            return n / self.letters
        if "A" <= c <= "z":
            return 1e-3
        o = ord(c)
        if c == "﻿":
            return 1e-4
        if 0x80 <= o < 0xA0 or c == _LOST or not (c.isprintable() or c in "\xa0\xad"):
            return 1e-9
        return 1e-7

    def restored(self, text: str) -> float:
        """The same for what a channel gives: there a stretch may also be known as a whole, with its signs."""
        whole = self.count(text)
        return max(self.score(text), math.log(0.7 * whole / self.total) if whole else -math.inf)

    def knows(self, text: str) -> bool:
        """Whether most characters beyond ASCII stand in words of the corpus: few unknown characters may be less
        improbable than many known ones, and still say nothing."""
        own = [c in self.single or c in self.alone for c in text if not c.isascii()]
        return 5 * sum(own) >= 3 * len(own)

    def pair(self, a: str, b: str) -> float:
        n = self.starts.get(a, 0)
        own = 0.1 if b == "$" else self.letter(b)
        return (self.pairs.get(a + b, 0) + 2.0 * own) / (n + 2.0)

    def word(self, w: str) -> float:
        p, logs, last = 1.0, 0.0, "^"
        for c in w:
            p *= self.pair(last, c)
            last = c
            if p < 1e-200:
                logs, p = logs + math.log(p), 1.0
        p *= self.pair(last, "$")
        if logs:  # too small for a float
            n = self.count(w)
            return max(math.log(0.7 * n / self.total) if n else -math.inf, math.log(0.3 * p) + logs)
        return math.log(0.7 * self.count(w) / self.total + 0.3 * p + 1e-300)

    def score(self, text: str) -> float:
        """Log-probability; letters make words, anything else stands alone."""
        known = self._score.get(text)
        if known is not None:
            return known
        out, word = 0.0, []
        for i, c in enumerate(text):
            if _letter(c):
                word.append(c)
                continue
            if word:
                out += self.word("".join(word))
                word = []
            if c.isascii():
                out += -4.0 if c.isprintable() else -20.0
            else:
                n = self.alone.get(c, 0)
                out += math.log(0.7 * n / self.total + 0.3 * self.letter(c) + 1e-300)
                if c not in _JOINS and text[i - 1 : i].isalpha() and text[i + 1 : i + 2].isalpha():
                    out -= AMID
        if word:
            out += self.word("".join(word))
        if len(self._score) < 1 << 20:
            self._score[text] = out
        return out


def _letter(c: str) -> bool:
    """Whether the character makes words."""
    return c.isalpha() or (c >= "\u0300" and unicodedata.category(c)[0] == "M")


def letter_counts(words: Iterable[tuple[str, int]]) -> dict:
    """Counts of letters and of pairs within words, of words of one character, and of all words."""
    pairs: dict[str, int] = defaultdict(int)
    single: dict[str, int] = defaultdict(int)
    alone: dict[str, int] = {}
    total = 0
    for w, n in words:
        last = "^"
        for c in w:
            pairs[last + c] += n
            single[c] += n
            last = c
        pairs[last + "$"] += n
        if len(w) == 1:
            alone[w] = alone.get(w, 0) + n
        total += n
    return {"pairs": dict(pairs), "single": dict(single), "alone": alone, "total": total}


#: A text that is being made up: nats of its finished words, the word begun with the logarithm of its pairs, all its text.
_State = tuple[float, str, float, str]


def _longer(state: _State, c: str, model: Model) -> _State:
    cost, word, logp, text = state
    if _letter(c):
        return cost, word + c, logp + math.log(model.pair(word[-1:] or "^", c)), text + c
    if word:
        cost += model.ended(word, logp)
    own = 4.0 if c.isascii() else -math.log(0.7 * model.alone.get(c, 0) / model.total + 0.3 * model.letter(c) + 1e-300)
    return cost + own, "", 0.0, text + c


def _cost(state: _State, model: Model) -> float:
    return state[0] + (model.begun(state[1], state[2]) if state[1] else 0.0)


def _done(state: _State, model: Model) -> float:
    return state[0] + (model.ended(state[1], state[2]) if state[1] else 0.0)


def viterbi(lattice: list[int | None], right: str, model: Model, beam: int = 24) -> tuple[str, float] | None:
    """The most probable text, under word frequencies, of a lattice of bytes in which some are lost, and the nats that
    bytes which fit no character, and are left out, have cost."""
    options = [bytes([b]) for b in range(0x80, 0x100)]
    # text so far, bytes of a character that has begun, nats of what was left out
    states: list[tuple[_State, bytes, float]] = [((0.0, "", 0.0, ""), b"", 0.0)]
    for b in lattice:
        new: dict[tuple[str, str, bytes], tuple[float, _State, bytes, float]] = {}

        def put(state: _State, held: bytes, drop: float, new=new) -> None:
            cost = _cost(state, model) + drop
            key = (state[3][-1:], state[1], held)
            if key not in new or cost < new[key][0]:
                new[key] = (cost, state, held, drop)

        for state, held, drop in states:
            for x in options if b is None else (bytes([b]),):
                try:
                    c = (held + x).decode(right)
                except UnicodeDecodeError as e:
                    if e.reason in ("unexpected end of data", "incomplete multibyte sequence"):
                        put(state, held + x, drop)
                else:
                    put(_longer(state, c, model), b"", drop)
            if b is not None and held and 0x80 <= b:  # what was held is the end of something cut off
                put(state, bytes([b]), drop + DROPPED * len(held))
        states = [x[1:] for x in sorted(new.values(), key=lambda x: x[0])[:beam]]
        if not states:
            return None
    done = [(_done(s, model) + drop + DROPPED * len(held), s[3], drop + DROPPED * len(held)) for s, held, drop in states if s[3]]
    return min(done)[1:] if done else None


def _fill(text: str, model: Model, beam: int = 24, fits=None) -> str:
    """The most probable text where each replacement character stands for one lost character (of those that fit)."""
    known = model.skeletons.get(text)
    if known and fits is None:
        return known
    options = [c for c in model.frequent if fits is None or fits(c)]
    states: list[_State] = [(0.0, "", 0.0, "")]
    for c in text:
        new = [_longer(state, x, model) for state in states for x in (options if c == _LOST else (c,))]
        states = sorted(new, key=lambda x: (_cost(x, model), x[3]))[:beam]
    return min(states, key=lambda x: (_done(x, model), x[3]))[3] if states else text


def _swapped(text: str) -> str | None:
    """ASCII text whose 16-bit units were read with their bytes the other way round."""
    return "".join(chr(ord(c) >> 8) for c in text) if _SWAPPED.fullmatch(text) else None


def _decoded(text: str, wrong: str, right: str, model: Model | None) -> tuple[str, float] | None:
    lattice = to_bytes(text, wrong)
    if lattice is None:
        return None
    if None not in lattice:
        data = bytes(lattice)  # type: ignore[arg-type]
        try:
            out = data.decode(right)
        except UnicodeError:
            out = None
        if out is not None:
            fits = right not in _WIDE or _eastern(out) or (model is not None and bool(model.count(out)))
            return (out, 0.0) if out != text and fits else None
        if right != "utf-8" or model is None or not _leads(data):
            return None
    elif model is None or right[:6] == "utf-16":
        return None
    elif right in _BYTE:
        return _lost_signs(lattice, right, model)
    elif right in _WIDE and not _eastern(bytes(b for b in lattice if b is not None).decode(right, "ignore")):
        return None
    if len(text) > PIECE:
        return _by_pieces(text, wrong, right, model)
    return viterbi(lattice, right, model)


def _lost_signs(lattice: list[int | None], right: str, model: Model) -> tuple[str, float] | None:
    """Where a byte is a character: those that are lost are made up of characters of that encoding."""
    table = _of_byte(right)
    shape = "".join(_LOST if b is None else table[b] for b in lattice)
    if not any(c != _LOST and not c.isascii() for c in shape) or not model.knows(shape.replace(_LOST, "")):
        return None  # nothing that would speak for this encoding
    return _fill(shape, model, fits=_to_byte(right).__contains__), 0.0


@lru_cache(maxsize=None)
def _of_byte(codec: str) -> list[str]:
    out = [chr(b) for b in range(256)]
    for c, b in _to_byte(codec).items():
        out[b] = c
    return out


def _by_pieces(text: str, wrong: str, right: str, model: Model) -> tuple[str, float] | None:
    """The search of a long stretch, in pieces; a piece that reads no better stays as it is."""
    out, cost = "", 0.0
    for piece in _pieces(text, wrong, right):
        found = _decoded(piece, wrong, right, model) if len(piece) <= 2 * PIECE else None
        if found is not None and gain_of(piece, wrong, right, *found, model) > 0:
            out, cost = out + found[0], cost + found[1]
        else:
            out += piece
    return (out, cost) if out != text else None


def _eastern(text: str) -> bool:
    """Whether all beyond ASCII is East Asian, as what comes out of such an encoding should be."""
    own = [c for c in text if not c.isascii()]
    return len(own) >= 2 and all("\u2e80" <= c <= "\ud7ff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uff60" for c in own)


def _leads(data: bytes) -> bool:
    """Whether some byte begins a UTF-8 character and one that continues it follows."""
    return any(a >= 0xC2 and a < 0xF5 and 0x80 <= b < 0xC0 for a, b in zip(data, data[1:], strict=False))


def reading(text: str, wrong: str, right: str, model: Model | None = None) -> tuple[str, float] | None:
    """What the stretch was before the channel, if it can have come through it, and the cost of bytes left out.
    ``utf-8 twice``: UTF-8 read as ``wrong``, and the result so once more. ``lost``: characters are gone."""
    if right == "utf-16-be" and _swapped(text) is not None:
        return _swapped(text), 0.0
    if "utf-16" in right and wrong == "latin-1" and "\0" not in text:
        return None
    if right == "lost":
        return (_fill(text, model), 0.0) if _LOST in text and model is not None and wrong == "utf-8" else None
    if right == "utf-8 twice":
        once = reading(text, wrong, "utf-8", model)
        if once is None or once[0].isascii():
            return None
        again = _decoded(once[0], wrong, "utf-8", None)
        return None if again is None else (again[0], once[1])
    return _decoded(text, wrong, right, model)


def readings(text: str, model: Model | None = None) -> Iterator[tuple[str, str, str, float]]:
    """``wrong, right, restored, cost`` for every channel by which the stretch can have come about."""
    swap = _swapped(text)
    if swap is not None:
        yield "utf-16-le", "utf-16-be", swap, 0.0
        return
    for wrong, right in CHANNELS:
        found = reading(text, wrong, right, model)
        if found is None:
            continue
        yield wrong, right, *found
        if right == "utf-8" and not found[0].isascii():
            again = _decoded(found[0], wrong, right, None)
            if again is not None:
                yield wrong, "utf-8 twice", again[0], found[1]
    lost = reading(text, "utf-8", "lost", model)
    if lost is not None:
        yield "utf-8", "lost", *lost


def gain_of(text: str, wrong: str, right: str, restored: str, cost: float, model: Model) -> float:
    """Nats by which the reading is better than the stretch as it stands; 0 or less: it is not."""
    if right[:6] == "utf-16" and (_swapped(text) is not None or "\0" in text):
        return 6.0 * len(text) if restored.isprintable() or restored.isascii() else 0.0
    if right[:5] != "utf-8" and not model.knows(restored):
        return 0.0
    own_form = "utf-8" in (wrong, right[:5])
    # where any text can be read so, the stretch too may be known as a whole, with its signs
    stands = model.score(text) if own_form or right in _WIDE else model.restored(text)
    return model.restored(restored) - stands - cost + (UTF8_PRIOR if own_form else OTHER_PRIOR)


def judge(text: str, model: Model) -> list[tuple[str, str, str, float]]:
    """Readings more probable than the stretch itself: ``wrong, right, restored, gain`` in nats."""
    out = []
    for wrong, right, restored, cost in readings(text, model):
        gain = gain_of(text, wrong, right, restored, cost, model)
        if gain > 0:
            out.append((wrong, right, restored, gain))
    if not out and any("\x80" <= c <= "\x9f" and c != "\x85" for c in text):
        out.append(("unknown", "lost", text, CONTROL))  # no text has these control characters
    return out


def explained(word: str, n: int, count: Callable[[str], int]) -> bool:
    """Whether some channel makes the word, which stands in ``n`` documents, of one that is far more frequent."""
    for _, right, restored, _ in readings(word):
        if right == "utf-16-be" and _swapped(word) is not None:
            return True
        if "\ufeff" in restored or (len(word) > 1 and count(restored) >= RARER * max(n, 1)):
            return True  # a byte order mark, or a known stretch
        known = [count(p) for p in _parts(restored) if not p.isascii()]
        if right[:5] != "utf-8" and (len(word) == 1 or not all(c.isascii() or c.isalpha() or c in _JOINS for c in restored)):
            continue  # one character, or a sign next to letters, says too little
        if known and min(known) >= RARER * max(n, 1) and not _amid(restored):
            return True
    return False


def _words(text: str) -> Iterator[str]:
    """The words that ``Model.score`` looks up, and the text itself."""
    yield text
    word = ""
    for c in text:
        if _letter(c):
            word += c
        else:
            yield word
            word = ""
    yield word


def forms(text: str, model: Model | None = None) -> set[str]:
    """All words that judging the stretch asks for. Words of one character and ASCII ones are none: the former are
    known to all, the latter never counted."""
    own = set(_words(text))
    for _, _, restored, _ in readings(text, model):
        own.update(_words(restored))
        own.update(_parts(restored))
    for wrong, right in CHANNELS:
        if right in _WIDE:  # known words in such an encoding need not be East Asian
            lattice = to_bytes(text, wrong)
            if lattice is not None and None not in lattice:
                own.add(bytes(lattice).decode(right, "ignore"))  # type: ignore[arg-type]
    return {w for w in own if len(w) > 1 and not w.isascii()}


def _parts(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+|[^\x00-\x7f]", text)


def _amid(text: str) -> bool:
    """Whether a sign other than those that join stands between letters."""
    return any(a.isalpha() and c.isalpha() and not (b.isalpha() or b.isascii() or b in _JOINS) for a, b, c in zip(text, text[1:], text[2:], strict=False))


def document_stretches(docs: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct ``<item>, stretch`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                if x and (not x.isascii() or "\0" in x):
                    own = {x[a:b] for a, b in stretches(x)}
                    rows += [i] * len(own)
                    found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=["item", "stretch"])

    kind = docs.schema[item].dataType.simpleString()
    return docs.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, stretch string")


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(shuffle_width(df.sparkSession))


def _asking(stretches: DataFrame, model: Model | None) -> DataFrame:
    """``stretch, n, form`` for each word that a stretch asks for. With a model, only of stretches with lost bytes, as
    all others ask for the same without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(batch.column("stretch").to_pylist()):
                if model is None or _LOST in x or not _sound(x):
                    own = forms(x, model)
                    at += [i] * len(own)
                    found += own
            rows = batch.select(["stretch", "n"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], names=["stretch", "n", "form"])

    return _spread(stretches.select("stretch", "n")).mapInArrow(run, "stretch string, n bigint, form string")


def _sound(text: str) -> bool:
    """Whether no channel leaves bytes over that only a search can place."""
    for wrong, right in CHANNELS:
        if right == "utf-8":
            lattice = to_bytes(text, wrong)
            if lattice is not None and None not in lattice and _leads(bytes(lattice)):  # type: ignore[arg-type]
                try:
                    bytes(lattice).decode()  # type: ignore[arg-type]
                except UnicodeError:
                    return False
    return True


def _answered(stretches: DataFrame, asked: DataFrame, words: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """``stretch, n, forms, counts``: the stretches with the counts of the words they ask for, where these have any. A
    word that very many stretches ask for is looked up where these stand."""
    asked = asked.withColumn("key", F.xxhash64("form"))
    wanted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    heavy = heavy_keys(wanted, "key", "m", asked.count(), heavy_share)
    known = words.select(F.col("stretch").alias("form"), F.col("n").alias("c")).withColumn("key", F.xxhash64("form"))
    met = split_join(asked, known, ["form"], "key", heavy).distinct()
    each = met.groupBy("stretch").agg(F.collect_list(F.struct("form", "c")).alias("both"))
    each = each.select("stretch", F.col("both.form").alias("forms"), F.col("both.c").alias("counts"))
    return stretches.select("stretch", "n").join(each, "stretch", "left")


def _counts(batch: pa.RecordBatch) -> Iterator[dict[str, int]]:
    for a, b in zip(batch.column("forms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
        yield dict(zip(a or (), b or (), strict=True))


def _letters_of(words: DataFrame) -> dict:
    """``letter_counts`` of all words, added up in the mappers first. As many rows come to the driver as there are pairs of
    letters, which the alphabets bound and not the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = letter_counts(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            rows = [(kind, k, n) for kind in ("pairs", "single", "alone") for k, n in own[kind].items()] + [("total", "", own["total"])]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), pa.int64()], strict=True)], names=["kind", "k", "n"])

    out: dict = {"pairs": {}, "single": {}, "alone": {}, "total": 0}
    for kind, k, n in words.select("stretch", "n").mapInArrow(run, "kind string, k string, n bigint").groupBy("kind", "k").agg(F.sum("n").alias("n")).collect():
        if kind == "total":
            out["total"] = n
        else:
            out[kind][k] = n
    return out


def _unexplained(rows: DataFrame, alone: dict[str, int]) -> DataFrame:
    """``stretch, n`` without the stretches that a channel makes of far more frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for w, n, own in zip(batch.column("stretch").to_pylist(), batch.column("n").to_pylist(), _counts(batch), strict=True):
                count = lambda x, own=own: alone.get(x, 0) if len(x) == 1 else own.get(x, 0)
                keep.append(_LOST not in w and not explained(w, n, count))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["stretch", "n"])

    return rows.mapInArrow(run, "stretch string, n bigint")


def judged_stretches(rows: DataFrame, model: Model) -> DataFrame:
    """``stretch, wrong, right, gain, restored`` for every reading better than the stretch, however many documents have
    it: what speaks for damage is a ratio of counts, which does not change with the size of the corpus. Rows without
    ``forms`` and ``counts`` are judged by the model's own words."""
    known = "forms" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for w, own in zip(batch.column("stretch").to_pylist(), _counts(batch) if known else iter(lambda: None, 0), strict=False):
                if own is not None:
                    model.asking(own)
                found += [(w, wrong, right, gain, restored) for wrong, right, restored, gain in judge(w, model)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            kinds = [pa.string()] * 3 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["stretch", "wrong", "right", "gain", "restored"])

    own = rows.select("stretch", *(["forms", "counts"] if known else []))
    return _spread(own).mapInArrow(run, "stretch string, wrong string, right string, gain double, restored string")


def fit(types: DataFrame, top_words: int = TOP_WORDS) -> tuple[Model, DataFrame]:
    """From counts ``stretch, n`` over all documents the model, with the letters of all words that no channel explains and
    the most frequent of these; and rows for ``judged_stretches``, with the counts of the words each asks for."""
    asked = cut(_asking(types, None))
    alone = {r[0]: r[1] for r in types.where("length(stretch) = 1").select("stretch", "n").collect()}
    clean = cut(_unexplained(_answered(types, asked, types), alone))
    letters = _letters_of(clean)
    top = clean.where("length(stretch) > 1").orderBy(F.col("n").desc(), "stretch").limit(top_words).collect()
    model = Model({r["stretch"]: r["n"] for r in top} | letters["alone"], letters)
    more = cut(_asking(types, model))
    return model, _answered(types, asked.unionByName(more), clean)


def _met(pairs: DataFrame, types: DataFrame, judged: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``item, stretch, wrong, right, gain``: stretches that read better, with the documents that have them."""
    verdicts = judged.drop("restored")
    wide = verdicts.agg(F.sum(F.octet_length("stretch") + 64)).first()[0] or 0
    if wide <= broadcast_bytes:
        return pairs.join(F.broadcast(verdicts), "stretch")
    # the few stretches that very many documents have go by broadcast, all others by a shuffle
    counts = types.withColumn("key", F.xxhash64("stretch"))
    heavy = heavy_keys(counts, "key", "n", types.agg(F.sum("n")).first()[0])
    key = F.xxhash64("stretch")
    return split_join(pairs.withColumn("key", key), verdicts.withColumn("key", key), ["stretch"], "key", heavy).drop("key")


def _judgements(docs: DataFrame, item: str, text: str, top_words: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judged stretches; ``item, stretch, wrong, right, gain``; and the gain of each channel in each document."""
    pairs = cut(document_stretches(docs, item, text))
    types = cut(pairs.distinct().groupBy("stretch").agg(F.count(F.lit(1)).alias("n")))
    model, rows = fit(types, top_words)
    judged = cut(judged_stretches(rows, model))
    met = _met(pairs, types, judged, broadcast_bytes).distinct()
    by_channel = met.groupBy("item", "wrong", "right").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("stretches"))
    return judged, met, by_channel


def _worst(by_channel: DataFrame) -> DataFrame:
    best = by_channel.groupBy("item").agg(F.max(F.struct("gain", "stretches", "wrong", "right")).alias("b"))
    return best.select("item", "b.wrong", "b.right", (F.col("b.gain") + DOCUMENT_PRIOR).alias("score"), "b.stretches").where("score > 0")


def damaged_documents(
    docs: DataFrame, item: str = "doc_id", text: str = "text", top_words: int = TOP_WORDS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Documents of whose text some stretch was read in the wrong encoding: ``<item>, wrong, right, score,
    stretches``, with the channel that explains most.

    A channel's gains are added up over the distinct stretches of a document and must outweigh the rarity of
    damage. ``lost`` for ``right``: replacement characters, whose bytes are gone; ``unknown`` for ``wrong``: control
    characters that no channel explains. Null, empty and ASCII texts (but those with a NUL at every other place) are
    not damaged. A repeated item counts once. What is escaped or foreign is judged by how common it is in the corpus,
    and so is no case.
    """
    found = _worst(_judgements(docs, item, text, top_words, broadcast_bytes)[2])
    return found.withColumnRenamed("item", item)


def _pieces(text: str, wrong: str, right: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut where a character of the channel ends. What begins or
    ends amid such a character, or cannot have come through the channel, is a piece of its own."""
    if right in ("utf-16-be", "lost"):
        yield from (text[i : i + PIECE] for i in range(0, len(text), PIECE))
        return
    steps = [codecs.getincrementaldecoder("utf-8" if right[:5] == "utf-8" else right)("replace") for _ in range(1 + (right == "utf-8 twice"))]
    start = border = 0
    sound = True  # whether what has come since ``start`` has a first character
    for i, c in enumerate(text):
        data = to_bytes(c, wrong)
        if data is None:  # not of this channel
            yield from (x for x in (text[start:border], text[border:i], c) if x)
            start = border = i + 1
            for d in steps:
                d.reset()
            continue
        now = "".join(chr(0x80 if b is None else b) for b in data).encode("latin-1")
        for k, d in enumerate(steps):
            read = d.decode(now)
            if k + 1 < len(steps):
                now = b"".join(bytes(x) for x in (to_bytes(y, wrong) for y in read) if x and None not in x)
        if any(d.getstate()[0] for d in steps):
            continue
        if start == border:
            sound = read != "" and _LOST not in read
        border = i + 1
        if border - start >= PIECE or not sound:
            yield text[start:border]
            start = border
    yield from (x for x in (text[start:border], text[border:]) if x)


def replaced(text: str, known: dict[str, str]) -> tuple[str, int]:
    """The text with every stretch replaced that is known to read better, and how many were. Of stretches that
    overlap the longest known one counts."""
    out, at, n = [], 0, 0
    for a, b in sorted(stretches(text), key=lambda x: (x[0], -x[1])):
        own = known.get(text[a:b]) if a >= at else None
        if own is not None:
            out += [text[at:a], own]
            at, n = b, n + 1
    return "".join(out) + text[at:], n


def restore(text: str, wrong: str, right: str, model: Model) -> tuple[str, int]:
    """The text with every stretch replaced that reads better by the channel, and how many were."""
    known = {}
    for own in {text[a:b] for a, b in stretches(text)}:
        found = reading(own, wrong, right, model)
        if found is not None and gain_of(own, wrong, right, *found, model) > 0:
            known[own] = found[0]
        elif len(own) > PIECE and right in ("utf-8", "utf-8 twice", *_BYTE, *_WIDE):
            whole = _in_parts(own, wrong, right, model)
            if whole != own:
                known[own] = whole
        if own not in known and _LOST in own and right != "lost":  # nothing of the channel is left but the loss
            found = reading(own, "utf-8", "lost", model)
            if found is not None and gain_of(own, "utf-8", "lost", *found, model) > 0:
                known[own] = found[0]
    return replaced(text, known)


def _in_parts(own: str, wrong: str, right: str, model: Model) -> str:
    out = ""
    for piece in _pieces(own, wrong, right):
        found = reading(piece, wrong, right, model)
        out += found[0] if found is not None and gain_of(piece, wrong, right, *found, model) > 0 else piece
    return out


def restored_documents(docs: DataFrame, item: str = "doc_id", text: str = "text", top_words: int = TOP_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``<item>, wrong, right, score, restored, replaced``: the damaged documents with the text as far as it can be
    restored, whole, and the number of stretches replaced (0: none could be).

    Each stretch is replaced by what it was before the channel that explains most of the document, or else before the
    next one that explains enough of it; where nothing but a loss is left, by the most probable text.
    """
    judged, met, by_channel = _judgements(docs, item, text, top_words, broadcast_bytes)
    by_channel = cut(by_channel)
    found = cut(_worst(by_channel))
    main = found.select("item", F.col("wrong").alias("_w"), F.col("right").alias("_r"))
    channels = by_channel.join(main, "item").withColumn("main", (F.col("wrong") == F.col("_w")) & (F.col("right") == F.col("_r")))
    channels = channels.where(F.col("main") | (F.col("right") == "lost") | (F.col("gain") + 2 * DOCUMENT_PRIOR > 0)).select("item", "wrong", "right", "main", F.col("gain").alias("whole"))
    each = met.join(channels, ["item", "wrong", "right"]).groupBy("item", "stretch").agg(F.max(F.struct("main", "whole", "gain", "wrong", "right")).alias("b"))
    read = judged.where("wrong <> 'unknown'").select("stretch", "wrong", "right", "restored")
    each = each.select("item", "stretch", "b.wrong", "b.right").join(read, ["stretch", "wrong", "right"])
    known = each.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("stretch", "restored"))).alias("known"))
    both = docs.select(F.col(item).alias("item"), F.col(text).alias("_text")).join(found, "item").join(known, "item", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replaced(x, dict(k or ())) for x, k in zip(batch.column("_text").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            arrays = [batch.column("item"), batch.column("wrong"), batch.column("right"), batch.column("score")]
            arrays += [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[item, "wrong", "right", "score", "restored", "replaced"])

    kind = docs.schema[item].dataType.simpleString()
    both = both.select("item", "wrong", "right", "score", "_text", "known")
    return both.mapInArrow(run, f"`{item}` {kind}, wrong string, right string, score double, restored string, replaced int")
