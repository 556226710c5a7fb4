"""Main body of web pages, and pages that have none but strung keywords, links or tags.

Both operators render a page into blocks (``layout``). Rendering gives all visible text; which of it
is the article is then told by what the corpus says of each line (a line shown by at least one body in
a hundred is furniture; copies of an article are one body), by link shares and by where the prose lies.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.layout import Block, Layout, blocks_of, render, tags_of
from quillspan.llm.nearcopies import components
from quillspan.operators.joins import BROADCAST_ROWS
from quillspan.session import materialize, release

#: A line is furniture if it stands around at least this share of all different bodies.
FURNITURE_SHARE = 0.01
#: Lines of this share of it in rows are common: known to every task, and no part of the texts that are measured.
COMMON_SHARE = 0.1
#: Lines of so many words tell a page's body.
BODY_WORDS = 8
#: A page without an article has at most so many sentences of prose ("a sentence or two").
LEAD_SENTENCES = 2
#: Keywords, links or tags are strung from this many words on.
LEAST_STRUNG = 20
#: Spreads below the usual compression ratio that count as extreme redundancy.
EXTREME = 9.0
#: Shapes of listed items are redundant if they compress to this share of what as many different ones do.
ALIKE = 0.75
#: Sentence ends a word, half of what prose has, up to which a redundant text is strung; an end counts if most of its sentence is new.
LOW_DENSITY = 0.033
#: A sentence is new if at least this share of its word pairs was not met before in the stretch.
NEW_SHARE = 0.75
#: A text is of a language if its frequent words make up this share of it.
LANGUAGE_WORDS = 0.1
#: Lengths of a language are fitted if so many different texts have them.
LEAST_TEXTS = 20
#: Usual ratio at 1024 characters, its slope a quarter octave, and its spread, where too few texts tell them.
UNKNOWN_USUAL = (0.56, -0.02, 0.03)
#: The spread counts as known from as many texts.
UNKNOWN_TEXTS = 50

_SENTENCE_END = re.compile(r"[.!?…;。！？](?=[\s”“\"’»)\]]|$)")
_SENTENCE = re.compile(r"[.!?…;。！？]+[”“\"’»)\]]*(?:\s+|$)")
_WHOLE_SENTENCE = re.compile(r"[.!?…;。！？][”“\"’»)]*$")
_NAME = re.compile(r"\b(?=([A-ZÀ-Þ][\w'-]*)( [A-ZÀ-Þ][\w'-]*)?)")
#: Forms of longer lines are kept as their ends and a hash.
LONG_LINE = 240
_SEPARATED = re.compile(r"\s*(?:[>»·|•]|&gt;|\s[–—/-]\s)\s*|\s{2,}")
#: One of these is in any line that _SEPARATED cuts and whose space is blanks only, as isprintable() tells.
_SEPARATORS = (">", "·", "|", "•", "»", "&gt;", " - ", " – ", " — ", " / ", "  ")
_FROM_DIGIT = re.compile(r"\d\w*")
_WORD_REST = re.compile(r"\w*")
#: All bytes but those that begin a decimal digit outside ASCII in UTF-8.
_NO_WIDE_DIGIT = bytes(set(range(256)) - {0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xEA, 0xEF, 0xF0})
_WORDS = re.compile(r"[^\W\d_]+")
#: Frequent words by which a text's language is told.
_FREQUENT = {
    "en": "the of and to in a is that it for was on with as by at from this".split(),
    "de": "der die das und in zu den von mit ist im des auf für ein eine nicht".split(),
    "fr": "le la les de des et en un une du est que dans pour au sur d l".split(),
    "es": "el la los de y en un una que es por con del las para se al".split(),
    "pt": "o a os de e em um uma que do da para com no na se ao".split(),
    "it": "il la di che e in un una per con del della non sono le gli al".split(),
    "nl": "de het een van en in is dat op te met voor niet zijn aan er".split(),
    "sv": "och i att det som en på är av för med den till inte ett om".split(),
    "pl": "w i z na do nie się jest to że o jak po za od dla".split(),
    "ru": "и в не на что с по это как из у к за от для но".split(),
}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _language, _words in _FREQUENT.items():
    for _word in _words:
        _LANGUAGES_OF.setdefault(_word, []).append(_language)


def language_of(text: str) -> str:
    """The language whose frequent words make up most of the text, and LANGUAGE_WORDS of it or more; else "latin"
    or "other" by the script of most letters. Strung keywords have no frequent words, so no language."""
    words = text.lower().split()
    votes: Counter[str] = Counter()
    for w, n in Counter(filter(_LANGUAGES_OF.__contains__, words)).items():
        for language in _LANGUAGES_OF[w]:
            votes[language] += n
    if votes:
        best = max(_FREQUENT, key=votes.__getitem__)
        if votes[best] >= LANGUAGE_WORDS * len(words):
            return best
    wide = 0 if text.isascii() else sum(c > "ͯ" for c in text)
    return "latin" if wide * 2 < len(text) else "other"


def _length_class(n: int) -> int:
    """Quarter octaves."""
    return int(4 * math.log2(n)) if n else 0


def measure(text: str) -> tuple[int, float]:
    """Length class and compression ratio of a text that is not empty."""
    raw = text.encode("utf-8", "replace")
    return _length_class(len(text)), len(zlib.compress(raw, 6)) / len(raw)


@dataclass
class Usual:
    """Usual compression ratios: per language a line over the length class, and the spread around it (overall, and
    of single classes where it is wider)."""

    lines: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    spreads: dict[tuple[str, int], float] = field(default_factory=dict)

    def redundancy(self, language: str, length: int, ratio: float) -> float:
        """How many spreads a ratio lies below the usual one of its language and length. A text of no language is
        held against the one that compresses least: words without grammar are at least as hard to foresee."""
        usual = lambda c: self.lines.get(c, UNKNOWN_USUAL)
        best = language if language in self.lines else max(self.lines, key=lambda c: usual(c)[0] + usual(c)[1] * (length - 40), default="")
        at, slope, spread = usual(best)
        return (max(0.02, at + slope * (length - 40)) - ratio) / max(spread, self.spreads.get((best, length), 0.0))


def fit_usual(rows: list[tuple[str, int, int, list[float]]]) -> Usual:
    """From (language, length class, different texts, quartiles of their ratios): lines through the medians, each
    class weighted by its texts, so that few spam pages of a length that articles hardly have do not matter."""
    by: dict[str, list[tuple[int, int, list[float]]]] = {}
    for language, length, n, quartiles in rows:
        if n >= LEAST_TEXTS and language not in ("latin", "other"):
            by.setdefault(language, []).append((length, n, quartiles))
    out = Usual()
    for language, classes in by.items():
        x, w, m, wide = (np.array([f(c) for c in sorted(classes)], float) for f in (lambda c: c[0] - 40, lambda c: c[1], lambda c: c[2][1], lambda c: (c[2][2] - c[2][0]) / 1.349))
        centre, level = (x * w).sum() / w.sum(), (m * w).sum() / w.sum()
        square = (w * (x - centre) ** 2).sum()
        slope = float((w * (x - centre) * (m - level)).sum() / square) if len(classes) > 2 else UNKNOWN_USUAL[1]
        spread = math.sqrt((((wide * w).sum() / w.sum()) ** 2 * w.sum() + UNKNOWN_USUAL[2] ** 2 * UNKNOWN_TEXTS) / (w.sum() + UNKNOWN_TEXTS))
        out.lines[language] = (float(level - slope * centre), slope, max(spread, 0.012))
        out.spreads |= {(language, int(c + 40)): float(v) for c, v in zip(x, wide, strict=True)}
    return out


@dataclass
class Corpus:
    """What all pages together say: lines that stand around many bodies, and the usual compression of bodies."""

    furniture: frozenset[str] = frozenset()
    usual: Usual = field(default_factory=Usual)
    ends: set[str] = field(default_factory=set)
    #: How lines with one of the ends begin or stop, in two characters; the first three words of long lines' keys.
    edges: set[str] = field(default_factory=set)
    long: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for f in self.furniture:
            if "0" in f:
                w = f.split()
                self.ends |= {" ".join(w[:3]), " ".join(w[-3:])}
            if "\0" in f:
                self.long.add(" ".join(f.split(None, 3)[:3]))
        self.edges |= {x for e in self.ends for x in (e[:2], e[-2:])}

    def holds(self, form: str) -> bool:
        """Whether lines of this form are furniture."""
        if len(form) < LONG_LINE:
            return form in self.furniture
        first = form.split(None, 3)[:3]
        return (len(first) < 3 or " ".join(first) in self.long) and _key(form) in self.furniture

    def names_another_site(self, line: str) -> bool:
        """Whether ``line`` is furniture but for one name: pages are copied from site to site."""
        first, last = line[:2], line[-2:]
        if first not in self.edges and last not in self.edges and first.isprintable() and last.isprintable() and " " not in (first[:1], last[-1:]):
            return False
        if " ".join(line.split(None, 3)[:3]) not in self.ends and " ".join(line.rsplit(None, 3)[-3:]) not in self.ends:
            return False
        line = _masked(line)
        return any(n and _key(line.replace(n, "0")) in self.furniture for a, b in _NAME.findall(line) for n in (a, b and a + b))


def site_names(host: str | None, title: str) -> list[str]:
    """How a page may name its site: labels of the host, and the end of the title."""
    names = [p for p in (host or "").split(".") if len(p) > 3]
    out = {" ".join(p.replace("-", " ").split()).title() for p in names}
    tail = re.split(r"\s[|–—-]\s", title)
    if len(tail) > 1 and 0 < len(tail[-1]) <= 40:
        out.add(tail[-1].strip())
    return sorted(out, key=len, reverse=True)


def _masked(line: str) -> str:
    """``line`` with 0 for each word that has a digit (sought from the digit, as few words have one)."""
    out, at = [], 0
    if line.isascii() or not line.encode("utf-8", "replace").translate(None, _NO_WIDE_DIGIT):
        for digit in "123456789":
            line = line.replace(digit, "0")
        found = line.find("0")
        while found >= 0:
            start = found
            while start > at and (line[start - 1].isalnum() or line[start - 1] == "_"):
                start -= 1
            out.append(line[at:start])
            at = _WORD_REST.match(line, found).end()
            found = line.find("0", at)
    else:
        for m in _FROM_DIGIT.finditer(line):
            start = m.start()
            while start > at and (line[start - 1].isalnum() or line[start - 1] == "_"):
                start -= 1
            out.append(line[at:start])
            at = m.end()
    return "0".join([*out, line[at:]]) if at else line


def line_form(line: str, names: list[str]) -> str:
    """A line without what varies by site or number (numbers of short lines stay: table cells)."""
    for n in names:
        if n in line:
            line = line.replace(n, "0")
    return _masked(line) if line.count(" ") > 2 else line


def line_forms(lines: list[str], names: list[str]) -> list[str]:
    """``line_form`` of each line, made of all at once."""
    text = "\n".join(lines)
    if not lines or text.count("\n") >= len(lines):
        return [line_form(x, names) for x in lines]
    for n in names:
        if n in text and "\n" not in n:
            text = text.replace(n, "0")
    masked = _masked(text)
    forms = text.split("\n")
    if masked == text:
        return forms
    return [m if f.count(" ") > 2 else f for f, m in zip(forms, masked.split("\n"), strict=True)]


_TITLE = re.compile(r"<title\b[^>]*>([^<]*)", re.I)
_CODE = re.compile(r"<(script|style|title)\b.*?</\1(?=[\s>])", re.I | re.S)


def _key(form: str) -> str:
    """What a form is counted by: itself, or for long ones the ends and a hash."""
    if len(form) < LONG_LINE:
        return form
    return f"{' '.join(form.split(None, 3)[:3])} \0{xxhash.xxh3_64_hexdigest(form)} {' '.join(form.rsplit(None, 3)[-3:])}"


def _page_names(page: str, host: str | None) -> list[str]:
    t = _TITLE.search(page)
    return site_names(host, html.unescape(t.group(1)).strip() if t else "")


def _visible_lines(page: str, host: str | None) -> dict[int, tuple[str, str]]:
    """By its id (a signed 64-bit name of its key), the key and the text of each different line of a page, in order."""
    shown = "\n".join([x for _, _, x in tags_of(_CODE.sub("<", page)) if x])
    if "\r" in shown:
        shown = shown.replace("\r", "\n")
    lines = [s for x in shown.split("\n") if (s := x.strip())]
    forms = line_forms(lines, _page_names(page, host))
    keys = dict(zip([f if len(f) < LONG_LINE else _key(f) for f in forms], lines, strict=True))
    return {xxhash.xxh3_64_intdigest(k) - (1 << 63): (k, s) for k, s in keys.items()}


def _body_words(words: list[int]) -> list[int]:
    """The words of the lines that tell a page's body, those of BODY_WORDS or more (all, where it has none); 0 for others."""
    return [w if w >= BODY_WORDS else 0 for w in words] if max(words, default=0) >= BODY_WORDS else words


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_no, lines, words) of each page that is not empty: ids of its different lines, and their words if they tell its body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines: list[list[int]] = []
            words: list[list[int]] = []
            for host, page in zip(b.column(0), b.column(1), strict=True):
                page = page.as_py()
                if page:
                    shown = _visible_lines(page, host.as_py())
                    lines.append(list(shown))
                    words.append(_body_words([s.count(" ") + 1 for _, s in shown.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=["lines", "words"])

    return pages.select("host", "page").mapInArrow(run, "lines array<long>, words array<int>").select(F.monotonically_increasing_id().alias("page_no"), "lines", "words")


def line_counts(lines: DataFrame) -> DataFrame:
    """(line, n): rows per line of ``page_lines``, of every line that more than one shows."""
    return lines.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def body_votes(lines: DataFrame, counts: DataFrame, common: dict[int, int], least: float) -> DataFrame:
    """(kind, i, j, n) of all pages, from ``page_lines`` and ``line_counts``; ``common`` are the counts from ``least`` on.

    If at least half of a page's body is in lines that no other row shows, the page has a body of its own:
    kind "page" counts these, "own" their repeated lines i. Else it is a copy of something: "seen"
    counts its repeated body lines i, "next" those that follow one another (i < j), and "shown" any repeated
    line i with j, the one in the middle of the page's body lines by how common they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: Counter[tuple[str, int, int]] = Counter()
        many = np.array([*common, *common.values()], np.int64).reshape(2, -1)
        for b in batches:
            lines, words, few = (b.column(c).flatten() for c in range(3))
            lines, words = lines.to_numpy(), words.to_numpy()
            repeated = np.concatenate([many, [few.field("line").to_numpy(), few.field("n").to_numpy()], [[(1 << 63) - 1], [0]]], axis=1)
            repeated = repeated[:, np.argsort(repeated[0], kind="stable")]
            at = np.searchsorted(repeated[0], lines)
            rows = np.where(repeated[0][at] == lines, repeated[1][at], 0)
            sizes = b.column(0).value_lengths().to_numpy()
            page = np.repeat(np.arange(len(sizes)), sizes)
            body, alone = (np.bincount(page, w, len(sizes)) for w in (words, words * (rows == 0)))
            own = 2 * alone >= body
            votes["page", 0, 0] += int(own.sum())
            ids, n = np.unique(lines[own[page] & (rows > 0)], return_counts=True)
            votes.update({("own", i, 0): k for i, k in zip(ids.tolist(), n.tolist(), strict=True)})
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(~own):
                known = [x for x in zip(*(v[ends[k] - sizes[k] : ends[k]].tolist() for v in (rows, lines, words)), strict=True) if x[0]]
                told = [(n, i) for n, i, w in known if w]
                usual = sorted(told)[len(told) // 2][1]  # neither a notice nor an edit
                votes.update(("seen", i, 0) for _, i in told)
                votes.update(("next", min(p, q), max(p, q)) for (_, p), (_, q) in zip(told, told[1:], strict=False))
                votes.update(("shown", i, usual) for _, i, _ in known)
            if len(votes) > 400_000:
                yield out(votes)
                votes = Counter()
        yield out(votes)

    def out(votes: Counter[tuple[str, int, int]]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in votes], t) for c, t in enumerate(kinds)), pa.array(votes.values(), pa.int64())], names=["kind", "i", "j", "n"])

    # Lines of many rows are known to each task, so that a join meets only those of few.
    single = lines.select("page_no", F.explode("lines").alias("line")).join(F.broadcast(counts.where(F.col("n") >= least)), "line", "left_anti")
    few = single.join(counts.where(F.col("n") < least), "line").groupBy("page_no").agg(F.collect_list(F.struct("line", "n")).alias("few"))
    told = lines.join(few, "page_no", "left").select("lines", "words", "few").mapInArrow(run, "kind string, i long, j long, n long")
    return told.groupBy("kind", "i", "j").agg(F.sum("n").alias("n"))


def bodies_of(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) of the nodes of (a, b) edges: one root for each connected component, found on the driver for up to ``limit`` edges."""
    edges = materialize(edges.select("a", "b"), "follow")
    if edges.count() > limit:
        roots = components(edges.select(F.col("a").alias("node")).union(edges.select("b")), edges)
        release(edges)
        return roots
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges.collect():
        up[root(a)] = root(b)
    release(edges)
    return F.broadcast(edges.sparkSession.createDataFrame([(i, root(i)) for i in list(up)], "node long, root long"))


def around_bodies(votes: DataFrame, common: DataFrame) -> tuple[DataFrame, int]:
    """(line, n), how many different bodies each repeated line stands with, and how many there are.

    Body lines of copies that follow one another at least half the time belong to one body, also where
    single lines are edited or moved; a notice follows many bodies, so it joins none.
    """
    seen = votes.where("kind = 'seen'").select(F.col("i").alias("node"), F.col("n").alias("seen"))
    edges = votes.where("kind = 'next'").select(F.col("i").alias("a"), F.col("j").alias("b"), "n")
    # Of a line of many rows at most four edges are left by the first round; other lines have few rows.
    many = seen.join(F.broadcast(common.select(F.col("line").alias("node"))), "node", "left_semi")
    for table, how in ((F.broadcast(many), "left"), (seen, "inner")):
        for end in ("a", "b"):
            edges = edges.join(table.withColumnRenamed("node", end), end, how).where("seen is null or 2 * n >= seen").drop("seen")
    shown = votes.where("kind = 'shown'").select(F.col("i").alias("line"), F.col("j").alias("node"))
    copies = materialize(shown.join(bodies_of(edges), "node", "left").select("line", F.coalesce("root", "node").alias("root")).distinct(), "copies")
    own = votes.where("kind = 'own'").select(F.col("i").alias("line"), "n")
    around = own.union(copies.select("line", F.lit(1).cast("long"))).groupBy("line").agg(F.sum("n").alias("n"))
    around = materialize(around, "around")
    pages = votes.where("kind = 'page'").agg(F.sum("n")).first()[0] or 0
    bodies = pages + copies.select("root").distinct().count()
    release(copies)
    return around, bodies


def body_texts(pages: DataFrame, common: frozenset[int], furniture: frozenset[int]) -> DataFrame:
    """(language, length, text, ratio) of each body that is mostly in no ``common`` line, ``text`` being its hash; and
    (line) rows with the keys of ``furniture``, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, str] = {}
        for b in batches:
            texts: list[tuple[str, int, int, float]] = []
            for host, page in zip(b.column(0), b.column(1), strict=True):
                page = page.as_py()
                if not page:
                    continue
                shown = _visible_lines(page, host.as_py())
                found |= {i: shown[i][0] for i in furniture.intersection(shown)}
                words = [s.count(" ") + 1 for _, s in shown.values()]
                least = BODY_WORDS if max(words, default=0) >= BODY_WORDS else 0
                rare = [(s, w) for (i, (_, s)), w in zip(shown.items(), words, strict=True) if i not in common]
                if 2 * sum([w for _, w in rare if w >= least]) < sum([w for w in words if w >= least]):
                    continue
                text = "\n".join([s for s, w in rare if w >= BODY_WORDS])
                if text:
                    length, ratio = measure(text)
                    texts.append((language_of(text), length, xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1, ratio))
            yield out(texts, [])
        yield out([], list(found.values()))

    def out(texts: list[tuple[str, int, int, float]], lines: list[str]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64()]
        measured = [pa.array([t[c] for t in texts] + [None] * len(lines), k) for c, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*measured, pa.array([None] * len(texts) + lines, pa.string())], names=["language", "length", "text", "ratio", "line"])

    return pages.select("host", "page").mapInArrow(run, "language string, length int, text long, ratio double, line string")


def learn_corpus(pages: DataFrame, least_share: float = FURNITURE_SHARE) -> Corpus:
    """Two passes over all (host, page) rows. Lines count once a body, however many copies of it there are.

    Every line of two rows or more is held against bodies, in tables. Lines that the driver gets are at most (lines
    per page) / (``least_share`` x COMMON_SHARE), those of many rows, and the furniture.
    """
    lines = materialize(page_lines(pages), "lines")
    counts = materialize(line_counts(lines), "counts")
    least = max(2, COMMON_SHARE * least_share * lines.count())
    many = counts.where(F.col("n") >= least)
    common = {r["line"]: r["n"] for r in many.toLocalIterator()}
    votes = materialize(body_votes(lines, counts, common, least), "votes")
    around, bodies = around_bodies(votes, many)
    furniture = frozenset(r["line"] for r in around.where(F.col("n") >= max(2, least_share * bodies)).toLocalIterator())
    told = materialize(body_texts(pages, frozenset(common), furniture), "texts")
    # Texts that are alike count once; at most languages x length classes rows.
    once = told.where("line is null").groupBy("language", "length", "text").agg(F.min("ratio").alias("ratio"))
    usual = once.groupBy("language", "length").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("ratio", [0.25, 0.5, 0.75], 1000).alias("q")).collect()
    keys = frozenset(r["line"] for r in told.where("line is not null").select("line").distinct().collect())
    for table in (lines, counts, votes, around, told):
        release(table)
    return Corpus(keys, fit_usual([(r["language"], r["length"], r["n"], list(r["q"])) for r in usual]))


@dataclass
class Judged:
    layout: Layout
    main: list[Block]
    #: Words and sentences of prose, and words outside sentences.
    prose: int
    strung: int
    keywords_only: bool
    #: The most redundancy of a stretch, and its density of new sentences.
    redundancy: float
    density: float


_COUNTED = re.compile(r"[^\W_]+(?:[ '’-]+[^\W_]+)*")


@lru_cache(maxsize=50_000)
def _shape(item: str, linked: bool) -> bytes:
    """Four bytes for the form of an item: whether it is a link, its marks, and how many words lie between them."""
    form = _COUNTED.sub(lambda m: "9" if m.group().isdigit() else f"w{m.group().count(' ')}", item)
    return xxhash.xxh32_digest(f"{linked}{form}")


def _items(b: Block) -> list[tuple[str, bool]]:
    """The links of a block one by one, and what stands between them."""
    out: list[tuple[str, bool]] = []
    for t, linked in zip(b.texts, b.linked, strict=True):
        if out and not linked and not out[-1][1]:
            out[-1] = (f"{out[-1][0]} {t}", False)
        else:
            out.append((t, linked))
    return out


def new_sentences(text: str) -> int:
    """How many of a text's sentences are mostly new, by their pairs of words."""
    new, at = 0, 0
    met: set[tuple[str, str]] = set()
    low = text.lower()
    for m in _SENTENCE.finditer(low):
        words = _WORDS.findall(low, at, m.start())
        at = m.end()
        pairs = set(zip(words, words[1:], strict=False)) - met
        new += len(words) > 2 and len(pairs) >= NEW_SHARE * (len(words) - 1)
        met |= pairs
    return new


def _strung(blocks: list[Block], texts: list[str], kinds: list[str], ends: list[int], usual: Usual) -> tuple[bool, float, float]:
    """Whether a page has no article but strung words; the most redundancy of a stretch, and its density of new sentences.

    Stretches of text between links that compress extremely well for their language and length, confirmed by
    rare new sentence ends, are strung. What is left of prose must be a sentence or two. Of lists of links and
    tags, whose words need not repeat, the shapes are compressed, with the marks, links and numbers of words.
    """
    stretches: list[list[int]] = [[]]
    for i, k in enumerate(kinds):
        if k in ("prose", "plain"):
            stretches[-1].append(i)
        elif k != "furniture" and stretches[-1]:
            stretches.append([])
    found, most, density = 0, 0.0, 0.0
    left = sum(e for e, k in zip(ends, kinds, strict=True) if k == "prose")
    for at in filter(None, stretches):
        text = "\n".join(texts[i] for i in at)
        length, ratio = measure(text)
        # What no language makes extreme needs none.
        z = usual.redundancy("", length, ratio)
        if z > EXTREME:
            z = usual.redundancy(language_of(text), length, ratio)
        if z > most or z > EXTREME:
            words = sum(blocks[i].words for i in at)
            rate = new_sentences(text) / max(1, words) if z > EXTREME else sum(ends[i] for i in at) / max(1, words)
            if z > most:
                most, density = z, rate
            if z > EXTREME and rate <= LOW_DENSITY:
                found = max(found, words)
                left -= sum(ends[i] for i in at if kinds[i] == "prose")
    if left > LEAD_SENTENCES:
        return False, most, density
    listed = [i for i, k in enumerate(kinds) if k in ("plain", "links", "label")]
    shapes = b"".join(_shape(t, linked) for i in listed for t, linked in _items(blocks[i]))
    words = sum(blocks[i].words for i in listed)
    if words >= LEAST_STRUNG and len(zlib.compress(shapes, 6)) <= ALIKE * (len(shapes) + 11) and sum(ends[i] for i in listed) <= LOW_DENSITY * words:
        found = max(found, words)
    return found >= LEAST_STRUNG, most, density


def judge(page: str, host: str | None, corpus: Corpus) -> Judged:
    """Blocks of a page told apart: prose, furniture, links, and the main body among them."""
    layout = blocks_of(page)
    names, blocks = site_names(host, layout.title), layout.blocks
    texts = [b.text for b in blocks]
    asked = [b.texts[0] for b in blocks] + [t for b, t in zip(blocks, texts, strict=True) if len(b.texts) > 1]
    forms = dict(zip(asked, line_forms(asked, names), strict=True))
    whole = "\n".join(asked)
    separators = [c for c in _SEPARATORS if c.strip() in whole and c in whole]  # single characters are sought faster

    def known(s: str) -> bool:
        form = forms.get(s)
        if form is None:
            form = line_form(s, names)
        if corpus.holds(form) or s != form and corpus.holds(s) or corpus.names_another_site(s):
            return True
        if s.isprintable() and not (any(c in s for c in separators) if s in forms else any(c in s for c in _SEPARATORS)):
            return False
        parts = [p for p in _SEPARATED.split(s) if p]
        return len(parts) > 1 and all(corpus.holds(line_form(p, names)) for p in parts)

    def is_furniture(b: Block, text: str) -> bool:
        return all(map(known, b.texts)) or len(b.texts) > 1 and known(text)

    kinds: list[str] = []
    ends: list[int] = []
    for b, text in zip(blocks, texts, strict=True):
        sentences = len(_SENTENCE_END.findall(text))
        if is_furniture(b, text):
            kind = "furniture"
        elif b.all_links and not _WHOLE_SENTENCE.search(text):
            kind = "links"
        elif b.heading or b.words < 4 or not sentences or b.words / sentences > 60:
            kind = "plain"
        else:
            kind = "prose"
        kinds.append(kind)
        ends.append(sentences)
    # Labels that other pages show too are strung all the same.
    listed = ["label" if k == "furniture" and b.all_links else k for k, b in zip(kinds, blocks, strict=True)]
    strung = _strung(blocks, texts, listed, ends, corpus.usual)
    _settle_cells(blocks, kinds)
    count = lambda *wanted: sum(b.words for b, k in zip(blocks, kinds, strict=True) if k in wanted)
    return Judged(layout, _main(blocks, kinds, layout.plain), count("prose"), count("plain", "links"), *strung)


def _settle_cells(blocks: list[Block], kinds: list[str]) -> None:
    """Items and cells that look like furniture (a common word in a table) follow the run they stand in."""
    at = 0
    while at < len(blocks):
        end = at + 1
        while end < len(blocks) and blocks[end].tag == blocks[at].tag:
            end += 1
        if blocks[at].cell and end - at > 1:
            own = sum(k in ("plain", "prose") for k in kinds[at:end])
            if 2 * own >= end - at:
                kinds[at:end] = ["plain" if k == "furniture" else k for k in kinds[at:end]]
        at = end


def _main(blocks: list[Block], kinds: list[str], plain: bool) -> list[Block]:
    """The run of blocks between links that holds most prose, from its heading to its last content, and further
    runs with prose in the same container: an article goes on behind a box of links."""
    runs, at = [], 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or kinds[i] == "links":
            inside = [k for k in range(at, i) if kinds[k] == "prose"]
            if inside:
                runs.append((sum(blocks[k].words for k in inside), at, i, inside))
            at = i + 1
    if not runs:
        return []
    best = max(runs, key=lambda r: r[0])
    home = {blocks[k].parent for k in best[3]} - {0}  # the page itself holds everything
    out = []
    for run in runs:
        if run is best or not plain and any(blocks[k].parent in home for k in run[3]):
            out += _between_notices(blocks, kinds, plain, *run[1:])
    return [blocks[k] for k in out]


def _between_notices(blocks: list[Block], kinds: list[str], plain: bool, at: int, end: int, inside: list[int]) -> list[int]:
    """A run's prose with the content without sentences at either end: what is next to it, and what lies beyond
    notices (in plain text only before the body, and beyond a full line of notice)."""
    first, last = inside[0], inside[-1]
    for step, edge, stop in ((-1, first, at - 1), (1, last, end)):
        k = edge + step
        while k != stop:
            if kinds[k] == "plain":
                edge = k
            elif kinds[k] != "furniture" or plain and (step > 0 or blocks[k].words < 5):
                break
            k += step
        first, last = (edge, last) if step < 0 else (first, edge)
    return [k for k in range(first, last + 1) if kinds[k] in ("prose", "plain")]


def _judge_rows(df: DataFrame, kept: list[str], schema: str, rows) -> DataFrame:
    """``rows(judged or None)`` gives the output tuples of a page; kept columns are repeated.

    Pages are read three times: for common lines, for the bodies these stand around, and to be judged.
    """
    corpus = df.sparkSession.sparkContext.broadcast(learn_corpus(df.select("host", "page")))
    fields = [f.split()[0] for f in schema.split(", ")]
    names = [*kept, *fields]
    full = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), schema])
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = corpus.value
        for b in batches:
            index: list[int] = []
            out: list[tuple] = []
            for i, (host, page) in enumerate(zip(b.column(0), b.column(1), strict=True)):
                page = page.as_py()
                got = rows(judge(page, host.as_py(), model) if page else None)
                index += [i] * len(got)
                out += got
            at = pa.array(index, pa.int64())
            cols = [b.column(j + 2).take(at) for j in range(len(kept))]
            new = [pa.array([r[j] for r in out], types[j]) for j in range(len(fields))]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=names)

    # The scan's partitions hold pages of any host, so no task meets only long ones.
    return df.select("host", "page", *[F.col(f"`{c}`").alias(f"__{c}") for c in kept]).mapInArrow(run, full)


def main_pieces(df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and ``piece_no`` INT of each piece of the main body of (host, page) rows.

    Pages that are null, empty, without an article, or of keywords only give no row. Repeated rows
    give their pieces each. Kept columns called ``piece_no`` are replaced.
    """
    return _judge_rows(df, [c for c in keep if c != "piece_no"], "piece_no int", lambda j: [] if j is None or j.keywords_only else [(p,) for b in j.main for p in b.pieces])


def main_text(df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and ``main`` STRING, the rendered main body; null where there is none."""
    return _judge_rows(df, [c for c in keep if c != "main"], "main string", lambda j: [(render(j.main) if j is not None and j.main and not j.keywords_only else None,)])


def keyword_pages(df: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns and, per (host, page) row, ``keywords_only`` BOOLEAN with its measures.

    ``prose`` and ``strung`` count words in and outside sentences, furniture left out; ``redundancy`` is the
    most spreads by which a stretch of the page compresses better than usual for its language and
    length (up to EXTREME: for the language that compresses least), ``density`` that stretch's sentence ends a word. Null and empty pages are none.
    """
    schema = "keywords_only boolean, prose int, strung int, density double, redundancy double"
    return _judge_rows(df, [c for c in keep if c not in {f.split()[0] for f in schema.split(", ")}], schema, lambda j: [(False, 0, 0, 0.0, 0.0) if j is None else (j.keywords_only, j.prose, j.strung, j.density, j.redundancy)])
