"""Texts decoded with a wrong encoding: find them and, where possible, restore them.

Round-trip repair: characters go back to bytes under the encoding that was used by mistake and are
strictly decoded under the one that was meant; this is repeated for nested layers and accepted only
when a garbling cost drops. The cost counts certain signs (replacement and C1 control characters,
byte sequences of UTF-8 shown as characters) and, for pairs of one-byte encodings, how rarely a
character stands between its neighbours in all different texts that are not suspect themselves: those
with a word of a form that no language has and that a pair turns into a usual one have no vote.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import materialize, release

#: Encodings by which UTF-8 bytes get shown, and (shown as, meant) pairs of one-byte encodings.
SHOWN_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8-r", "cp866")
ONE_BYTE_PAIRS = (
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "cp1251"), ("koi8-r", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp866", "cp1251"),
    ("cp1251", "koi8-r"), ("cp1252", "koi8-r"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
)
#: Layers that are taken off at most; a text garbled more often is found, and reported with what is left.
MAX_LAYERS = 8
#: Words whose costs and readings a task keeps.
KEPT_WORDS = 100_000

_C1 = re.compile("[\x80-\x9f]")
_LETTER_ENTITY = re.compile(r"&[A-Za-z]{1,2}(?:grave|acute|circ|tilde|uml|ring|cedil|slash|lig|th|horn|caron);|&(?:ETH|eth|THORN|thorn|szlig|euro|sbquo|bdquo|hellip|dagger|Dagger|permil|lsaquo|rsaquo|lsquo|rsquo|ldquo|rdquo|bull|ndash|mdash|tilde|trade|iexcl|cent|pound|curren|yen|brvbar|sect|uml|copy|ordf|laquo|not|shy|reg|macr|deg|plusmn|sup[123]|acute|micro|para|middot|cedil|ordm|raquo|frac1[24]|frac34|iquest|times|divide|nbsp|fnof|Yuml);")


def _to_byte(encoding: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves open show as control characters."""
    return {bytes([b]).decode(encoding, "ignore") or chr(b): b for b in range(256)}


_BYTES = {e: _to_byte(e) for e in {*SHOWN_AS, *(w for w, _ in ONE_BYTE_PAIRS)}}


def _sequences(encoding: str) -> re.Pattern:
    chars = {b: c for c, b in _BYTES[encoding].items()}
    kind = lambda a, z: "[" + "".join(re.escape(chars[b]) for b in range(a, z + 1) if b in chars) + "]"
    after = kind(0x80, 0xBF)
    return re.compile(f"{kind(0xC2, 0xDF)}{after}|{kind(0xE0, 0xEF)}{after}{{2}}|{kind(0xF0, 0xF4)}{after}{{3}}")


_SEQUENCES = {e: _sequences(e) for e in SHOWN_AS}


def _starts() -> re.Pattern:
    """Two characters with which a sequence of any encoding may start."""
    kind = lambda a, z: "".join(sorted({re.escape(c) for e in SHOWN_AS for c, b in _BYTES[e].items() if a <= b <= z}))
    return re.compile(f"[{kind(0xC2, 0xF4)}][{kind(0x80, 0xBF)}]")


_STARTS = _starts()
#: Ranges in which a repaired character may lie: C1 (of a deeper layer), Latin, Greek, Cyrillic, Semitic, Indic, kana, Han, Hangul, punctuation, symbols.
_PLAUSIBLE = re.compile("[\x80-ſƒˆˇ˘-˝\u0300-\u0304\u0306-\u0308\u030a-\u030c\u0327\u0328Ά-ώЀ-џҐґא-תء-يऀ-ॿก-๎\u200b-\u200f‐-⁉€№™←-↓∞≠≤≥─-▀　-ヿ一-鿿가-힣ﬁﬂ️﻿！-～\U0001f1e6-\U0001faff]")
_CYRILLIC = re.compile("[Ѐ-џ]")
_CYRILLIC_WORD = re.compile("[Ѐ-џ]+")
_SIGN = re.compile("[\u2010-\u2049€™]")
_OTHER_SCRIPT = re.compile("[\u0370-\u1fff\u2e80-\ud7ff\uf900-\ufaff\uff00-\uffef]")
_BOXES = re.compile("[─-▟]+")
_KANA = re.compile("[぀-ヿ]")
_CJK = re.compile("[、-ヿ一-鿿！-～]")
_TORN = re.compile("[A-Za-z][、-ヿ一-鿿]|[、-ヿ一-鿿][A-Za-z]")
_NON_ASCII_WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
_MIXED = re.compile("[A-Za-z][Ѐ-џ]|[Ѐ-џ][A-Za-z]")
_JAPANESE_SIGN = re.compile("\x81[@-~\x80-ü]")
_AT_LETTER = re.compile(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]|[0-9][^\W\d_a-zA-Z]|[^\W\d_a-zA-Z]{2}")
#: Forms of words that no language has: a capital or sign in small letters, scripts or cases mixed, accents only.
_ILL = re.compile(
    "[a-zß-öø-ÿ][À-ÖØ-ÞŒŠŽŸ](?![A-ZÀ-ÖØ-ÞŒŠŽŸ])|[^\\W\\d_][¡-©«-¬®-´¶-¹»-¿×÷ˆ-˝†-‡•…‰€™∂-≥◊─-▟ﬁﬂ‚„ƒªº⁄№][^\\W\\d_]|[A-Za-z][\u0370-\u03ffЀ-џ]|[\u0370-\u03ffЀ-џ][A-Za-z]"
    "|\\b[а-яё][А-ЯЁ]{2}|[À-ÖØ-öø-ÿ]{4}|[Ѐ-џ][─-▟]|[─-▟][Ѐ-џ]"
)
_WIDE = re.compile("[⺀-퟿豈-﫿＀-￯\U00010000-\U0010ffff]")


def _decoded(match: str, encoding: str) -> str | None:
    try:
        out = bytes(_BYTES[encoding][c] for c in match).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return out if _PLAUSIBLE.fullmatch(out) else None


def _unpack_utf8(text: str, encoding: str) -> tuple[str, int]:
    """``text`` with plausible UTF-8 sequences decoded, and how many there were.

    Only lone sequences that give a letter of another script are no sign: quotes beside a letter look so.
    Nor are box drawings, or a capital before a quote, without a letter beside them.
    """
    found = [(m, d) for m in _SEQUENCES[encoding].finditer(text) if (d := _decoded(m.group(), encoding))]
    if encoding == "cp866":  # three Cyrillic letters can be a sequence: only one that gives a sign counts
        found = [(m, d) for m, d in found if not _CYRILLIC_WORD.fullmatch(m.group()) or _SIGN.fullmatch(d)]
    runs: list[list[tuple[re.Match, str]]] = []
    for m, d in found:
        if runs and not re.search(r"\s", text[runs[-1][-1][0].end() : m.start()]):
            runs[-1].append((m, d))
        else:
            runs.append([(m, d)])
    out, at, n = [], 0, 0
    many = any(len(run) > 1 for run in runs)
    for run in runs:
        if len(run) < 2 and _OTHER_SCRIPT.match(run[0][1]) and not many and not _C1.search(run[0][0].group()):
            continue
        start, end = run[0][0].start(), run[-1][0].end()
        lone = not (text[start - 1 : start].isalpha() or text[end : end + 1].isalpha())
        if lone and (_BOXES.fullmatch(text, start, end) or len(run) == 1 and "\u0100" <= run[0][1] <= "\u017f"):
            continue
        for m, d in run:
            out += [text[at : m.start()], d]
            at, n = m.end(), n + 1
    return "".join(out) + text[at:], n


@dataclass
class ContextCost:
    """Cost of a character by the share of documents that show it between such neighbours."""

    documents: int = 0
    seen: dict[str, int] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)
    #: Words a task has met: their cost, and their readings.
    costs: dict[str, float] = field(default_factory=dict, repr=False)
    readings: dict[str, list[tuple[int, str, float, float]]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for c, n in self.seen.items():
            if len(c) == 3:
                self.most[c[1]] = max(n, self.most.get(c[1], 0))

    def rare_character(self, word: str) -> bool:
        """Whether a character of ``word`` is rare in every context."""
        return any(self.most.get(c, 0) < 0.004 * self.documents for c in word if c > "\x7f")

    def known(self, word: str) -> float:
        """The cost of a word, kept for the next time."""
        got = self.costs.get(word)
        if got is None:
            if len(self.costs) >= KEPT_WORDS:
                self.costs.clear()
            got = self.costs[word] = self.of(word)
        return got

    def read(self, word: str) -> list[tuple[int, str, float, float]]:
        """(pair, reading, gain, lenient gain) of a word under each pair of encodings that makes another word of it."""
        got = self.readings.get(word)
        if got is None:
            if len(self.readings) >= KEPT_WORDS:
                self.readings.clear()
            before, got = self.known(word), []
            for i, (shown, meant) in enumerate(ONE_BYTE_PAIRS):
                r = _re_read(word, shown, meant)
                if r is not None and r != word and not _C1.search(r):
                    got.append((i, r, before - self.of(r), before - self.of(r, True)))
            self.readings[word] = got
        return got

    def of(self, word: str, lenient: bool = False) -> float:
        """``lenient`` lets a sign stand beside any letter where it does beside many."""
        if self.documents <= 0:
            return 0.0
        total = 0.0
        for exact, loose in _places(word):
            seen = self.seen.get(exact, 0)
            if lenient and loose:
                seen = max(seen, self.seen.get(loose, 0))
            total += math.log((self.documents + 1) / (seen + 0.5))
        return total


def _near(c: str) -> str:
    if c.isspace():
        return " "
    if c < "\x80":
        return c.lower() if c.isalpha() else "0" if c.isdigit() else "."
    return "L" if c.islower() else "U" if c.isalpha() else "."


def _kind(c: str) -> str:
    return "a" if c.isalpha() else _near(c)


def _places(word: str) -> list[tuple[str, str]]:
    """Each non-ASCII, non-CJK character of ``word`` between its neighbours; for signs, also between kinds of them."""
    w = f" {word} "
    out = []
    for i, c in enumerate(w):
        if c > "\x7f" and not _WIDE.match(c):
            loose = "" if c.isalpha() else f"={_kind(w[i - 1])}{c}{_kind(w[i + 1])}"
            out.append((_near(w[i - 1]) + c + _near(w[i + 1]), loose))
    return out


@lru_cache(maxsize=KEPT_WORDS)
def contexts(word: str) -> tuple[str, ...]:
    """What is counted of a word: the places of its characters."""
    return tuple(p for both in _places(word) for p in both if p)


#: Characters to those of the same bytes' numbers; what an encoding lacks becomes one that is no byte.
_AS_BYTES = {e: {c: 0xFFFF for c in range(0x80, 0x100)} | {ord(c): b for c, b in table.items() if c > "\x7f"} for e, table in _BYTES.items()}


def _re_read(word: str, shown: str, meant: str) -> str | None:
    try:
        return word.translate(_AS_BYTES[shown]).encode("latin-1").decode(meant)
    except UnicodeError:
        return None


def _re_read_words(text: str, cost: ContextCost) -> tuple[str, float]:
    """The one-byte pair whose repair lowers the cost most, over all words it betters."""
    words = dict.fromkeys(_NON_ASCII_WORD.findall(text))
    if not words or cost.documents <= 0:
        return text, 0.0
    rare = math.log(250)
    telling = [w for w in words if cost.known(w) >= rare or _MIXED.search(w)]

    def is_evidence(w: str, r: str, gain: float) -> bool:
        # One word must turn from very rare to common, by a character that is rare itself or stands at a letter
        # or digit, or be a lone letter that was a sign (an ellipsis on its own is merely in a rare place); or
        # mix Latin and Cyrillic letters, and no more.
        if gain <= 0:
            return False
        if _MIXED.search(w) and not _MIXED.search(r):
            return True
        return gain >= 4.0 and cost.known(w) >= rare and bool(_AT_LETTER.search(w) or cost.rare_character(w) or w.isalpha() and len(w) == 1 and not r.isalpha())

    # First by exact places; signs found beside rarer letters only if that settles nothing.
    for lenient in (0, 1):
        # Most texts have no evidence under any pair; only where there is some are all words read.
        proven = {pair for w in telling for pair, r, *gain in cost.read(w) if is_evidence(w, r, gain[lenient])}
        if not proven:
            continue
        swaps: dict[int, dict[str, str]] = {}
        drops: Counter[int] = Counter()
        for w in words:
            for pair, r, *gain in cost.read(w):
                if gain[lenient] > 0:
                    swaps.setdefault(pair, {})[w] = r
                    drops[pair] += gain[lenient]
        best = max(sorted(drops), key=drops.__getitem__)
        if best in proven:
            swap = swaps[best]
            return _NON_ASCII_WORD.sub(lambda m: swap.get(m.group(), m.group()), text), drops[best]
    return text, 0.0


def suspect(text: str) -> bool:
    """Whether a word has a form that no language has and that some pair of one-byte encodings mends."""
    if not _ILL.search(text):
        return False
    for w in set(_NON_ASCII_WORD.findall(text)):
        if _ILL.search(w):
            for shown, meant in ONE_BYTE_PAIRS:
                r = _re_read(w, shown, meant)
                if r is not None and r != w and not _ILL.search(r) and not _C1.search(r):
                    return True
    return False


#: Characters as which the first bytes of Japanese signs (three) and of Cyrillic letters (one) are shown.
_LEADS = {e: ([c for c, b in _BYTES[e].items() if b in (0x81, 0x82, 0x83)], next(c for c, b in _BYTES[e].items() if b == 0x84)) for e in ("cp1252", "mac_roman", "latin-1")}
_NON_ASCII = re.compile(r"[^\x00-\x7f]")


def _as_shift_jis(line: str) -> str | None:
    """A line of Japanese shown as Western text; blanks and ASCII stay."""
    if line.isascii() or len(_NON_ASCII.findall(line)) < 4:
        return None
    for shown, (signs, cyrillic) in _LEADS.items():
        if line.count(cyrillic) < 6 and sum(map(line.count, signs)) < 2:  # too few to pass below
            continue
        r = _re_read(line, shown, "cp932")
        if not r or re.search("[｡-ﾟ\x80-\x9f]", r):
            continue
        wide, torn = len(_CJK.findall(r)), len(_TORN.findall(r))
        if wide >= 4 and len(_KANA.findall(r)) >= 2 and torn <= wide / 10 or len(_CYRILLIC.findall(r)) >= 6:
            return r
    return None


def certain_signs(text: str) -> int:
    """Replacement characters, C1 controls, and UTF-8 sequences shown as characters."""
    if text.isascii() and "&" not in text:
        return 0
    plain = _LETTER_ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text
    shown = max(_unpack_utf8(plain, e)[1] for e in SHOWN_AS) if _STARTS.search(plain) else 0
    return text.count("�") + len(_C1.findall(text)) + shown


def _layer(text: str, cost: ContextCost) -> str | None:
    """One layer less, or None if no repair lowers the cost."""
    lines = text.split("\n")
    japanese = [(_as_shift_jis(x) or x) for x in lines]
    if japanese != lines:
        return "\n".join(japanese)
    plain = _LETTER_ENTITY.sub(lambda m: html.unescape(m.group()), text) if "&" in text else text
    best, n = max((_unpack_utf8(plain, e) for e in SHOWN_AS), key=lambda x: x[1]) if _STARTS.search(plain) else (plain, 0)
    if n and certain_signs(best) < certain_signs(text) + n:
        return best
    signs = _JAPANESE_SIGN.sub(lambda m: _re_read(m.group(), "cp1252", "cp932") or m.group(), text) if "\x81" in text else text
    if signs != text:
        return signs
    if _C1.search(text):  # Windows text read as ISO 8859-1
        read = _C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "ignore") or m.group(), text)
        if read != text:
            return read
    new, drop = _re_read_words(text, cost)
    return new if drop > 0 else None


@dataclass(frozen=True)
class Repair:
    garbled: bool
    restored: str | None
    layers: int


def repair(text: str | None, cost: ContextCost) -> Repair:
    """Whether ``text`` is garbled, and its restored form where a repair removes every certain sign.

    Null, empty and plain ASCII texts are not garbled. A lost (replacement) character is garbling that
    cannot be restored.
    """
    if not text or (text.isascii() and "&" not in text):
        return Repair(False, None, 0)
    path = [text]
    while len(path) <= MAX_LAYERS and (new := _layer(path[-1], cost)) is not None:
        if new in path:  # repairs that lead back repair nothing
            path = path[: path.index(new) + 1]
            break
        path.append(new)
    now, layers = path[-1], len(path) - 1
    garbled = layers > 0 or "�" in text or bool(_C1.search(text))
    return Repair(garbled, now if layers and not certain_signs(now) else None, layers)


def context_counts(df: DataFrame, text: str) -> DataFrame:
    """(context, docs): in how many different texts each context occurs, suspect ones left out; the row of the
    empty context has the number of texts that vote. Partial sums per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if t.isascii():
                    part[""] += 1
                elif not suspect(t):
                    part[""] += 1
                    part.update({c for w in set(_NON_ASCII_WORD.findall(t)) for c in contexts(w)})
            if len(part) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(part.keys(), pa.string()), pa.array(part.values(), pa.int64())], names=["context", "docs"])
                part.clear()
        yield pa.RecordBatch.from_arrays([pa.array(part.keys(), pa.string()), pa.array(part.values(), pa.int64())], names=["context", "docs"])

    texts = df.select(F.col(f"`{text}`").alias("t")).where("t is not null").distinct()
    return texts.mapInArrow(run, "context string, docs long").groupBy("context").agg(F.sum("docs").alias("docs"))


def repair_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, least_share: float = 1e-4) -> DataFrame:
    """Kept columns, ``garbled`` BOOLEAN, ``restored`` STRING (null where nothing is to be or can be restored), ``layers`` INT.

    Every row gives one row, whatever its text (null, empty, very long, repeated). Kept columns with
    those three names are replaced. Contexts are counted over all different texts that are not suspect; those in
    fewer than ``least_share`` of them count as unseen, which bounds what is sent to the tasks.
    """
    spark = df.sparkSession
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("garbled", "restored", "layers")]
    counts = materialize(context_counts(df, text), "contexts")
    n = next((r["docs"] for r in counts.where("context = ''").collect()), 0)
    common = counts.where((F.col("context") != "") & (F.col("docs") >= max(2, least_share * n)))
    cost = spark.sparkContext.broadcast(ContextCost(n, {r["context"]: r["docs"] for r in common.toLocalIterator()}))
    release(counts)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "garbled boolean, restored string, layers int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cost.value
        for b in batches:
            got = [repair(t.as_py(), model) for t in b.column(0)]
            new = [pa.array([g.garbled for g in got], pa.bool_()), pa.array([g.restored for g in got], pa.string()), pa.array([g.layers for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *new], names=[*kept, "garbled", "restored", "layers"])

    return df.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
