"""Abusive, hateful and sexually explicit language: a weighted lexicon matched by Aho-Corasick.

A text is folded to a stream of letters: compatibility forms, accents, homoglyphs of other scripts and
digits that stand for letters are undone, runs of a letter are shortened, and everything that isn't a
letter is dropped. So a phrase is found whatever its case, alphabet, spacing, punctuation, line breaks
and comment marks. A hit counts if it begins and ends where words do, in scripts that part words, and if no
sentence ends within it. Insults with a left-out letter are in the automaton as variants made by rule. A word
with signs between its letters ("f*ck", "m***n", "@sshole") is read as every word of the lexicon that it may
stand for.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.llm import lexicon
from vertexloom.session import ship

#: Stands for a word with masked letters in folded text; its readings are kept beside the text.
SLOT = "\x02"
#: Hits within so many letters of the stream count together.
WINDOW = 120
#: Strength from which a document is a case.
THRESHOLD = 1.0
#: Score from which a document is a case whatever the distance of its hits.
DENSE = 2.0
#: The score is strength summed over hits per so many letters (a shorter text counts as this long).
PER_LETTERS = 1000

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("абвгдезийкмнорстухіјѕԁԛԝһӏαβγεικνορτυχω", "abvrdeзийkmhopctyxijsdqwhlabyeiknoptuxw"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"$": "s", "€": "e", "£": "l", "ı": "i", "ł": "l", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ё": "е"}

_NUMBER = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_SIGN = re.compile(r"(?<=[^\W\d_])[$](?=[^\W_])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_ASCII = {c: None for c in range(128) if not chr(c).isalpha() and chr(c) != SLOT} | {ord(k): v for k, v in LEET.items()}
#: Signs written for letters within a word, and those that may also begin one.
_LEAD = {"@": "a", "$": "s", "!": "i"}
_SIGNS = r"*#%@!$&^?+~|•●×"
_SIGNED = re.compile(
    rf"(?<![^\W_])(?:[@$!][^\W_]++(?:[{_SIGNS}]+[^\W_]++)*|[^\W_]++(?:[{_SIGNS}]+[^\W_]++)+|(?<!-)[^\W\d_]++-{{1,3}}[^\W_]++(?![-_{_SIGNS}]))"
)
_PARTS = re.compile(rf"([-{_SIGNS}]+)")


class _Letters(dict):
    """str.translate table that decides each further character once."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in HOMOGLYPHS:
            r = HOMOGLYPHS[c]
        elif c in SIGNS:
            r = HOMOGLYPHS.get(SIGNS[c], SIGNS[c])
        else:
            r = c if c.isalpha() else None
        self[code] = r
        return r


_OTHER = _Letters(_ASCII | {ord(SLOT): SLOT})


def fold(text: str) -> str:
    """The letter stream of a text."""
    return read(text)[0]


@lru_cache(maxsize=1 << 16)
def _plain(word: str) -> str:
    """The letter stream of a word of the lexicon, which hides no letters."""
    return _RUN.sub(r"\1", unicodedata.normalize("NFKD", word).lower().translate(_OTHER))


def read(text: str) -> tuple[str, list[tuple[str, ...]], str]:
    """The letter stream of a text, the readings of each SLOT in it, and the text before all but letters was dropped."""
    plain = text.isascii()
    if not plain:
        text = unicodedata.normalize("NFKD", text)
    text = text.lower()
    text = text.replace(SLOT, "")
    slots: list[tuple[str, ...]] = []

    def slot(m: re.Match) -> str:
        variable = m[0][0] == "$" and text[m.end() : m.end() + 1] in ("[", "=", "-", "(", ")", "{", ":")  # $name of code
        r = () if variable else _readings(m[0])
        if not r:
            return m[0]
        slots.append(r)
        return SLOT

    text = _SIGNED.sub(slot, text)
    if "$" in text:
        text = _SIGN.sub("s", text)
    text = _NUMBER.sub(" ", text)
    return _RUN.sub(r"\1", text.translate(_ASCII if plain else _OTHER)), slots, text


class _Kinds(dict):
    """str.translate table to the kinds of characters: L for each letter of the stream, w white space, = signs of
    base64, e ends of sentences, p other punctuation, d what may be either, o anything else."""

    def __missing__(self, code: int):
        c = chr(code)
        new = c.translate(_OTHER)
        kind = "L" * len(new) if new else "w" if c.isspace() else "=" if c in "+/=" else "e" if c in "。！？" else "d" if c in ".;!?" else "p" if c in ",:、" else "o"
        self[code] = kind
        return kind


_KINDS = _Kinds()
_BASE64 = re.compile(r"(?<=L)=(?=L)")
_SENTENCE = re.compile(r"d(?=w|$)")
_BREAK = re.compile(r"[^L]+")


class _Gaps:
    """What stands in front of each letter of the stream, and behind the last: 0 the letter before it, 1 something
    else, 2 punctuation of sentences, 3 the end of a sentence. Only what isn't 0 is kept."""

    def __init__(self, raw: str):
        kinds = _SENTENCE.sub("e", _BASE64.sub("", raw.translate(_KINDS)))
        at, dropped = {0: 3}, 0
        for m in _BREAK.finditer(kinds):
            run = m[0]
            at[m.start() - dropped] = 3 if "e" in run else 2 if "d" in run or "p" in run else 1
            dropped += len(run)
        n = len(kinds) - dropped
        if any(_RUN.finditer(letters := raw.translate(_OTHER))):
            gone = [k for m in _RUN.finditer(letters) for k in range(m.start() + 1, m.end())]
            taken, at = set(gone), {k - bisect_right(gone, k - 1): v for k, v in at.items() if k not in set(gone)}
            n -= len(taken)
        at[0] = at[n] = 3
        self.at = at
        self.ends = sorted(k for k, v in at.items() if v == 3)
        self.marks = sorted(k for k, v in at.items() if v >= 2)

    def __getitem__(self, k: int) -> int:
        return self.at.get(k, 0)

    def within(self, where: list[int], start: int, end: int) -> bool:
        """Whether one of ``where`` lies after ``start`` and before ``end``."""
        k = bisect_right(where, start)
        return k < len(where) and where[k] < end


@lru_cache(maxsize=1 << 16)
def _readings(token: str) -> tuple[str, ...]:
    """What a word with signs may stand for: its letters alone, and the words of the lexicon of which it hides
    letters, each sign one letter but several stars any number, followed by what the token has beyond such a
    word. Empty if there is no such word."""
    longest, words = _vocabulary()
    if len(token) > 2 * longest:
        return ()
    lead = _LEAD.get(token[0], "")
    parts = _PARTS.split(token[1:] if lead else token)
    letters = [_RUN.sub(r"\1", x.translate(_OTHER)) for x in parts[::2]]
    letters[0] = lead + letters[0]
    if not all(letters):
        return ()
    *before, last = letters
    # Words that begin as the token does; sorted, so they lie together. Most tokens of code have none.
    of = words.get(letters[0][0], [])
    of = of[bisect_left(of, letters[0]) : bisect_left(of, letters[0] + "\uffff")] if before else of
    of = [w for w in of if last[0] in w[len(letters[0]) :]] if before else [w for w in of if last.startswith(w)]
    if not of:
        return ()
    head = "".join(re.escape(x) + (".+" if len(m) > 1 and not m.strip("*") else "." * len(m)) for x, m in zip(before, parts[1::2]))
    out = []
    for k in range(len(last), 0, -1):
        whole = re.compile(head + re.escape(last[:k])).fullmatch
        out += [w + last[k:] for w in of if whole(w)]
        if not before:
            break  # a sign in front hides nothing: the word has to be there as it is
    return tuple(dict.fromkeys([*out, "".join(letters)])) if out else ()


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[int, dict[str, list[str]]]:
    """Letters of the longest word, and the alphabetic words of three letters or more by their first letter."""
    words = {_plain(w) for w in {x for e in entries() for x in e.phrase.split()}}
    by: dict[str, list[str]] = {}
    for w in sorted(w for w in words if len(w) >= 3 and ord(w[0]) < 0x500):
        by.setdefault(w[0], []).append(w)
    return max(map(len, words)), by


def _variants(word: str) -> set[str]:
    """A folded word as it stands, with one inner letter left out, and with its double letters single."""
    out = {word}
    if len(word) >= 7 and ord(word[0]) < 0x500:  # alphabets, not ideographs
        out |= {word[:i] + word[i + 1 :] for i in range(1, len(word) - 1)}
    return out | {re.sub(r"(.)\1", r"\1", x) for x in out if len(x) >= 6}


def _list(text: str) -> list[str]:
    return [w.strip() for w in text.replace("\n", " ").split(";") if w.strip()]


@dataclass(frozen=True)
class Entry:
    phrase: str  # words parted by blanks
    weight: float
    category: str
    family: int  # the line it comes from
    varied: frozenset[str] = frozenset()  # its forms beside the plain one


_GROUP = re.compile(r"\(([^()\[\]]*)\)|\[([^()\[\]]*)\]")


def _choices(frame: str) -> list[str]:
    """The phrases of a frame: one of each (a|b), one or none of each [a|b]; inner ones first."""
    m = _GROUP.search(frame)
    if not m:
        return [" ".join(frame.split())]
    options = m[1].split("|") if m[1] is not None else ["", *m[2].split("|")]
    return [x for o in options for x in _choices(frame[: m.start()] + o + frame[m.end() :])]


@lru_cache(maxsize=1)
def _slots() -> dict[str, list[tuple[str, bool]]]:
    """The lists of words, and whether a word may be read with a letter missing."""
    return {n: [(w.lstrip("~"), n in "IJK" and not w.startswith("~")) for w in _list(text)] for n, text in lexicon.LISTS.items()}


def _filled(frame: str, weight: float, category: str, family: int) -> list[Entry]:
    """The entries of a frame. Words of the lists of insults are also there with a letter missing."""
    out = []
    for phrase in _choices(frame):
        parts = re.split(r"\{(\w+)\}", phrase)
        for words in product(*[_slots()[n] for n in parts[1::2]]):
            whole = "".join(x for pair in zip(parts[::2], [*[w for w, _ in words], ""]) for x in pair)
            varied = frozenset()
            if words and words[-1][1]:
                last = words[-1][0].split()
                if whole.endswith(words[-1][0]):
                    head = "".join(_plain(w) for w in whole.split()[: -1])
                    varied = frozenset(head + v for v in _variants(_plain(last[-1])))
            out.append(Entry(whole, weight, category, family, varied))
    return out


@lru_cache(maxsize=1)
def entries() -> tuple[Entry, ...]:
    out, family = [], 0
    for category, block in (("abusive", lexicon.ABUSIVE), ("hateful", lexicon.HATEFUL), ("sexual", lexicon.SEXUAL), ("light", lexicon.LIGHT), ("swearing", lexicon.SWEARING)):
        for line in block.strip().splitlines():
            weight, frame = line.split(" ", 1)
            family += 1
            out += _filled(frame, float(weight), category, family)
    return tuple(out)


@lru_cache(maxsize=1)
def automaton():
    """Built once in each Python worker from the lexicon (its size is fixed by the lexicon)."""
    import ahocorasick

    best: dict[str, tuple[float, str, str, int]] = {}
    for e in entries():
        plain = _RUN.sub(r"\1", "".join(_plain(w) for w in e.phrase.split()))
        single = re.sub(r"(.)\1", r"\1", plain) if len(plain) >= 9 else plain
        for v in {plain, single, *e.varied}:
            if len(v) > 1 and (v not in best or best[v][0] < e.weight):
                best[v] = (e.weight, e.category, e.phrase, e.family)
    for line in lexicon.EXCEPTIONS.strip().splitlines():
        for e in _filled(line, 0.0, "exception", 0):
            best[_plain(e.phrase)] = (0.0, "exception", e.phrase, 0)
    a = ahocorasick.Automaton()
    for v, (w, c, p, family) in best.items():
        a.add_word(v, (len(v), w, c, p, family))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _longest() -> int:
    return max(map(len, automaton()))


def _over_slots(stream: str, slots: list[tuple[str, ...]]) -> set[tuple[int, int, float, str, str, int]]:
    """The hits that pass over at least one SLOT, in any of its readings."""
    a = automaton()
    readings = dict(zip((m.start() for m in re.finditer(SLOT, stream)), slots))
    out = set()
    for start in sorted({s for p in readings for s in range(max(0, p - _longest()), p + 1)}):
        todo = [(start, "", False)]
        while todo:
            i, prefix, over = todo.pop()
            if i == len(stream):
                continue
            masked = i in readings
            for piece in readings.get(i, (stream[i],)):
                longer = prefix
                for k, c in enumerate(piece, 1):
                    longer += c
                    if not a.match(longer):
                        break
                    if (over or masked) and longer in a and k == len(piece):
                        out.add((start, i + 1, *a.get(longer)[1:]))
                else:
                    todo.append((i + 1, longer, over or masked))
    return out


def _word_ends(stream: str, gaps: _Gaps, end: int) -> bool:
    """Whether a word ends here, or with the s of a plural."""
    return gaps[end] > 0 or stream[end : end + 1] == "s" and gaps[end + 1] > 0


def _spaced(letter: str) -> bool:
    """Whether the script of a letter parts words by blanks."""
    return ord(letter) < 0x1100 or 0xAC00 <= ord(letter) <= 0xD7FF


def hits(text: str) -> tuple[list[tuple[int, int, float, str, str, int]], int]:
    """(start, end, weight, category, phrase, family) of what counts, and the number of letters."""
    stream, slots, raw = read(text)
    every = [(end - n + 1, end + 1, *rest) for end, (n, *rest) in automaton().iter(stream)]
    if slots:
        every += _over_slots(stream, slots)
    if not every:
        return [], len(stream)
    gaps = _Gaps(raw)
    worded = lambda h: (gaps[h[0]] or not _spaced(stream[h[0]])) and (not _spaced(stream[h[1] - 1]) or _word_ends(stream, gaps, h[1]))
    every = [h for h in every if worded(h) and not gaps.within(gaps.ends, h[0], h[1])]
    spared = sorted((h[0], h[1]) for h in every if not h[2] and not gaps.within(gaps.marks, h[0], h[1]))
    starts, reach = [a for a, _ in spared], [*accumulate((b for _, b in spared), max)]
    inside = lambda h: (k := bisect_right(starts, h[0])) and reach[k - 1] >= h[1]  # noqa: E731 - some exception begins before it and ends behind it
    return [h for h in every if h[2] and not inside(h)], len(stream)


def rate(text: str) -> tuple[float, float, int, list[str]]:
    """(score, strength, hits, categories).

    strength is the greatest summed weight of different, not overlapping phrases within WINDOW letters:
    it does not fall with the length of the text. score is the summed weight of the non-overlapping hits
    but swearing per PER_LETTERS letters. Light phrases of one line of the lexicon count once in a window.
    """
    found, letters = hits(text)
    if not found:
        return 0.0, 0.0, 0, []
    found.sort(key=lambda h: (-h[2], h[0] - h[1], h[0]))
    taken, kept = bytearray(letters), []
    for h in found:
        if taken.find(1, h[0], h[1]) < 0:
            taken[h[0] : h[1]] = b"\x01" * (h[1] - h[0])
            kept.append(h)
    kept.sort()
    strength, low = 0.0, 0
    for i, h in enumerate(kept):
        while kept[low][0] < h[1] - WINDOW:
            low += 1
        seen: dict = {}
        for k in kept[low : i + 1]:
            key = k[5] if k[2] < 1 else k[4]
            seen[key] = max(k[2], seen.get(key, 0.0))
        strength = max(strength, sum(seen.values()))
    total = sum(h[2] for h in kept if h[3] != "swearing")
    return total * PER_LETTERS / max(letters, PER_LETTERS), strength, len(kept), sorted({h[3] for h in kept if h[3] not in ("light", "swearing")})


SCHEMA = "score double, strength double, n_hits int, categories array<string>"


def score_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, score, strength, n_hits and categories of every document.

    Null, empty and blank texts score 0 without hits. Texts are matched whole, however long. Names of
    ``keep`` must differ from the four result columns. No shuffle; an Arrow batch holds few documents,
    so very long texts don't add up.
    """
    clash = set(keep) & {"score", "strength", "n_hits", "categories"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results")
    ship(docs.sparkSession)
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for b in batches:
            got = [rate(t) if t else (0.0, 0.0, 0, []) for t in b.column(b.num_columns - 1).to_pylist()]
            score, strength, n, cats = zip(*got) if got else ((), (), (), ())
            cols = [*b.columns[:-1], pa.array(score, pa.float64()), pa.array(strength, pa.float64()), pa.array(n, pa.int32()), pa.array(cats, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "score", "strength", "n_hits", "categories"])

    return src.mapInArrow(run, f"{fields}, {SCHEMA}")


def is_case() -> Column:
    """Hits that are strong together within a short stretch, or many of them for the length of the text."""
    return (F.col("strength") >= THRESHOLD) | (F.col("score") >= DENSE)


def source_name(source: str = "source") -> Column:
    """One spelling for each source: outer blanks, case and separators don't matter; blank is null."""
    s = F.lower(F.regexp_replace(F.trim(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s_\-./]+", "-"))
    return F.when(s != "", s)


def rates(scored: DataFrame) -> DataFrame:
    """``source, n_documents, n_cases, rate, mean_score``; documents without a source are one row with null."""
    return scored.groupBy(source_name().alias("source")).agg(
        F.count("*").alias("n_documents"),
        F.count_if(is_case()).alias("n_cases"),
        (F.count_if(is_case()) / F.count("*")).alias("rate"),
        F.avg("score").alias("mean_score"),
    )
