"""Pages made of repeated keywords, bare links or product tags instead of sentences.

The suffix automaton of the whole page, with the words of its links, the characters of its tags and its
marks, gives both measures that decide; no list of words of any language is used.

* Coverage. The automaton tells the longest repeated substring that ends at each position; a place is
  covered if such a substring of at least ``LEAST_REPEAT`` characters runs over it.
* Clause structure. A page is cut into segments at line ends and sentence ends. A segment of short
  pieces between separators, links or tags leaves no room for a clause. A longer one is a clause if it
  keeps an order: two neighbours are free if the automaton also knows them the other way round, if
  they are equal, or if the segment has them twice; words of sentences rarely are, keywords strewn at random mostly. A segment's share
  of free neighbours is smoothed by that of its page. Scripts without spaces are read by character.

A page is a case if the covered part of what lies outside clauses is at least ``SHARE`` of its mass. Code
and rows of figures count as mass, but neither as clauses nor as keywords; they are told by their marks.
Every page is measured whole, in one narrow pass; nothing is compared between pages.

Patterns that are searched for begin with one set of characters, which the engine skips to, and look back
from there. Lines of ASCII and pages without such scripts get plainer patterns of the same meaning, and
coverage is only counted on pages where something lies outside clauses.

Defined cases: null, empty and blank texts have no mass and are no case; repeated rows give one id;
texts of any length are read whole.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from itertools import accumulate, pairwise
from operator import contains, eq, mul

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of a page's mass that lies outside clauses and in repeats from which on it is a case.
SHARE = 0.45
#: Least length of a repeat in characters; a character of a script without spaces counts as two.
LEAST_REPEAT = 4
#: Share of free neighbours from which on a segment keeps no order, and the weight of the page's own
#: share in it, in pairs of neighbours.
FREE = 0.1
PRIOR = 8
#: Least words of a clause, and least characters of one in a script without spaces.
CLAUSE_WORDS = 5
CLAUSE_CHARACTERS = 7
#: Most words between two separators, on average, of a list.
PIECE_WORDS = 3.2
#: Share of a page's lines with marks of code from which on its lines without a clause are code, too.
CODE_LINES = 0.25

PLAIN_MARKS = ",;|>/~-\t"
LINK, TAG, ITEM_END = "\x02", "\x04", "\x03"

_WIDE_CLASS = "぀-ヿ㐀-鿿"
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ANCHOR = re.compile(r"<a\b([^<>]*)>(.*?)</a\s*>", re.I | re.S)
_HREF = re.compile(r"href\s*=\s*[\"']?([^\"'\s]*)", re.I)
_BLOCK = re.compile(r"</?(?:p|h\d|li|ul|ol|div|br|tr|td|th|table|html|body|head|title|nav)\b[^<>]*>", re.I)
_ELEMENT = re.compile(r"</?[A-Za-z][^<>\n]*>")
_WIKI = re.compile(r"\[\[([^\[\]\n]*)\]\]")
_MARKDOWN = re.compile(r"!?\[([^\[\]\n]*)\]\(([^()\s]*)\)")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\x02\x03]+")
_TAGS = re.compile(r"(?<![\w&])[#@][\w-]*[^\W\d_][\w-]*|(?<![\w/`.])[a-z]{2,12}:[^\W_][\w-]*")
_TAGGED = re.compile(r"[#@:]\w")
_TAG_SIGN = re.compile(r"[#@:](?:(?<=[#@])[\w-]|(?<=[a-z]:)[^\W_])")  # every tag has one
_ITEM = re.compile("([\x02\x04])([^\x03]*)\x03")
_ITEMS = re.compile("([\x02\x04][^\x03]*\x03)")
_FIGURES = re.compile(r"^\s*\|.*\|\s*$|^[\s\d.,;:|%+-]+$")
_FRONT_LIST = re.compile(r"^\s*[\w-]+\s*:\s*(?=\[|[^,]*,)")
_CODE = re.compile(r"[{}=\\(/*\"\-:\[](?:(?<=[{}=\\])|(?<=[A-Za-z0-9_\])]\()|(?<=\w\[)|(?<=/)[/*]|(?<=\*)/|(?<=\")\"\"|(?<=-)>|(?<=:):)")
_SENTENCE_END = re.compile(r"[.!?…。！？](?:(?<=[.!?…])(?<![.!?…].)[.!?…]*(?=\s|$|[)\"'»”])|(?<=[。！？])[。！？]*)")
_SEPARATOR = re.compile(r"\s*(?:[,;|·»>•、，/]|\s[-–—~]\s|[^\S\n]{2,}|\t)\s*")
_MARKS = re.compile(r"[,;|·»>•、，/–—~-]")
_GAPS = re.compile(r"[^\S\n](?:[^\S\n]+|(?<=\t))")
_PLAIN_SEPARATORS = re.compile(r"[,;|>/~-]|  +|\t")
_PLAIN_END = re.compile(r"[.!?](?<![.!?].)[.!?]*(?=\s|$|[)\"'])")
_WIDE = re.compile(f"[{_WIDE_CLASS}]")
_WIDE_RUN = re.compile(f"[{_WIDE_CLASS}]+")
_WORD = re.compile(r"[^\W_]+(?:['’_-][^\W_]+)*")
_TOKEN = re.compile(rf"[{_WIDE_CLASS}]|[^\W_{_WIDE_CLASS}]+(?:['’_-][^\W_{_WIDE_CLASS}]+)*")
_PLAIN_TOKEN = re.compile(r"[a-z0-9]+(?:['_-][a-z0-9]+)*")
_LINK_TOKEN = re.compile(rf"[{_WIDE_CLASS}]|[^\W_{_WIDE_CLASS}]+")


class SuffixAutomaton:
    """Suffix automaton of a sequence of symbols; ``following[following[0][s]]`` holds what follows ``s`` somewhere.

    A symbol that occurs once is in no repeat, so it is written as None and only cuts the sequence: the
    automaton is that of the parts between, which has the same repeats. As all others occur at least twice,
    each has its own state from the start, the one after which it begins; so the root needs no search.
    """

    def __init__(self, symbols: list[int | None]) -> None:
        first = {s: k for k, s in enumerate({*symbols} - {None}, 1)}
        states = len(first) + 1
        most = 2 * (len(symbols) + states)
        length, link, following, again = [1] * most, [0] * most, [first, *({} for _ in first)], bytearray(most)
        length[0] = 0
        again[1:states] = b"\1" * len(first)
        at, last = [0] * len(symbols), 0
        for i, s in enumerate(symbols):
            if s is None:
                last = 0
                continue
            if not last:
                at[i] = last = first[s]
                continue
            there = following[last]
            if s in there:
                q = there[s]
                if length[last] + 1 == length[q]:
                    again[q] = 1
                    at[i] = last = q
                    continue
                new = 0
                p = last
            else:
                new = states
                states += 1
                length[new] = length[last] + 1
                following.append({})
                there[s] = new
                p = link[last]
                if not p:
                    link[new] = first[s]
                    at[i] = last = new
                    continue
            while True:
                there = following[p]
                if s in there:
                    q = there[s]
                    if length[p] + 1 == length[q]:
                        link[new] = q
                        again[q] = 1
                    else:
                        clone = states
                        states += 1
                        length[clone] = length[p] + 1
                        link[clone] = link[q]
                        following.append(following[q].copy())
                        link[q] = clone
                        again[clone] = again[link[clone]] = 1
                        if new:
                            link[new] = clone
                        else:
                            new = clone
                        while there.get(s) == q:
                            there[s] = clone
                            p = link[p]
                            there = following[p]
                    break
                there[s] = new
                p = link[p]
            at[i] = last = new
        self.length, self.link, self.following, self.at, self.again = length, link, following, at, again

    def repeats(self) -> list[int]:
        """Length of the longest substring that ends at each position and occurs at least twice.

        A state occurs more than once if it was met again or another is linked to it, as is that to which
        any state is linked.
        """
        again, length, link = self.again, self.length, self.link
        return [(length[s] if again[s] else length[link[s]]) if s else 0 for s in self.at]


def _outside_items(form: Callable[[str], str], text: str) -> str:
    if ITEM_END not in text:
        return form(text)
    return "".join(p if p.endswith(ITEM_END) else form(p) for p in _ITEMS.split(text))


def _with_urls(text: str) -> str:
    return _URL.sub(rf"{LINK}\g<0>{ITEM_END}", text)


def _with_tags(text: str) -> str:
    if not _TAG_SIGN.search(text):
        return text
    return "\n".join(_TAGS.sub(rf"{TAG}\g<0>{ITEM_END}", line) if _TAG_SIGN.search(line) else line for line in text.split("\n"))


def _anchored(match: re.Match) -> str:
    target = _HREF.search(match[1])
    label = _ELEMENT.sub(" ", match[2]).replace("\n", " ")
    return f"{LINK}{label} {target[1] if target else ''}{ITEM_END}"


def _marked(text: str) -> str:
    """Text with links and tags as marked items and without other markup."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = _ELEMENT.sub(" ", _BLOCK.sub("\n", _ANCHOR.sub(_anchored, text)))
    if "&" in text:
        text = html.unescape(text)
    if "[[" in text:
        text = _WIKI.sub(f"{LINK}\\1{ITEM_END}", text)
    if "](" in text:
        text = _MARKDOWN.sub(f"{LINK}\\1 \\2{ITEM_END}", text)
    if "://" in text or "www." in text:
        text = _outside_items(_with_urls, text)
    if _TAGGED.search(text):
        text = _outside_items(_with_tags, text)
    return text


def _is_list(segment: str, words: list[str], tagged: bool, any_wide: bool = True, marks: str = PLAIN_MARKS) -> bool:
    """Short pieces between separators. In scripts without spaces a space is one.

    ``any_wide`` and ``marks`` tell whether such a script, and which separators of ASCII, are on the page.
    """
    if tagged and len(_WORD.findall(segment)) <= 8:
        return True
    if segment.isascii():
        if sum(map(segment.count, marks)) + segment.count("  ") < 3:
            return False
        pieces = len(_PLAIN_SEPARATORS.findall(segment)) + 1
    else:
        if any_wide and _WIDE.search(segment):
            runs = _WIDE_RUN.findall(segment)
            wide = sum(map(len, runs))
            if 2 * wide > len(words):
                long = sum(len(r) for r in runs if len(r) >= CLAUSE_CHARACTERS)
                return 2 * long < wide or (len(runs) >= 4 and wide < CLAUSE_CHARACTERS * len(runs))
        pieces = len(_MARKS.findall(segment)) + len(_GAPS.findall(segment)) + 1
    if pieces >= 4:
        pieces = sum(1 for p in _SEPARATOR.split(segment) if p.strip(" -*+#>|"))
    return pieces >= 4 and len(words) <= PIECE_WORDS * pieces


def read_page(text: str) -> tuple[list[str], list[tuple[str, int, int, int]], bool]:
    """All words of a page in order, with marks of links, tags and ends; its segments; and whether it has a
    character of a script without spaces.

    A segment is its kind (running, short, listed, item, code or head), its line and where its tokens
    begin and end.
    """
    tokens: list[str] = []
    segments: list[tuple[str, int, int, int]] = []
    fenced = front = begun = False
    text = _marked(text).lower()
    any_wide = not text.isascii() and _WIDE.search(text) is not None
    other_words = _TOKEN.findall if any_wide else _WORD.findall
    any_items = ITEM_END in text
    marks = "".join(c for c in PLAIN_MARKS if c in text or (c == "," and any_items))
    for n, line in enumerate(text.split("\n")):
        bare = line.strip()
        if not bare:
            continue
        has_items, start, first, kind = any_items and ITEM_END in line, len(tokens), bare[0], ""
        if first == "`" and bare.startswith("```"):
            fenced = not fenced
            kind = "head"
        elif first == "-" and bare == "---":
            front = not begun and not front
            kind = "head"
        elif fenced:
            kind = "code"
        elif front:
            listing = _FRONT_LIST.match(bare)
            kind, line = ("", bare[listing.end() :]) if listing else ("head", line)
        elif first == "#" and not has_items:
            kind = "head"
        elif _is_figures(bare) or (not has_items and (_CODE.search(bare) or bare.startswith("$ "))):
            kind = "code"
        begun = begun or not front
        if kind:
            tokens += _PLAIN_TOKEN.findall(bare) if bare.isascii() else other_words(bare)
            segments.append((kind, n, start, len(tokens)))
            tokens.append("\n")
            continue
        tagged = False
        if has_items:
            tagged = TAG in line
            for mark, inner in _ITEM.findall(line):
                start = len(tokens)
                tokens.append(mark)
                tokens += inner if mark == TAG else _LINK_TOKEN.findall(inner)
                tokens.append(ITEM_END)
                segments.append(("item", n, start, len(tokens)))
            line = _ITEM.sub(" , ", line)
        words_of, sentences_of = (_PLAIN_TOKEN.findall, _PLAIN_END.split) if line.isascii() else (other_words, _SENTENCE_END.split)
        for segment in sentences_of(line):
            words = words_of(segment)
            if words:
                kind = "short" if len(words) < CLAUSE_WORDS else "listed" if _is_list(segment, words, tagged, any_wide, marks) else "running"
                start = len(tokens)
                tokens += words
                segments.append((kind, n, start, len(tokens)))
                tokens.append("\n")
    return tokens, segments, any_wide


def _is_figures(line: str) -> bool:
    if line[0].isalpha() or not _FIGURES.match(line):
        return False
    words = _WORD.findall(line)
    return 4 * sum(w[0].isdigit() for w in words) >= len(words) or set(line) <= set("|-: ")


def covered_places(longest: list[int], size_to: list[int], least: int = LEAST_REPEAT) -> bytearray:
    """Whether each position lies in a repeated substring of ``least`` characters or more."""
    covered, reach = bytearray(len(longest)), len(longest)
    for i in range(len(longest) - 1, -1, -1):
        if n := longest[i]:
            begin = i - n + 1
            if begin < reach and size_to[i + 1] - size_to[begin] >= least:
                reach = begin
            covered[i] = i >= reach
    return covered


@functools.lru_cache(maxsize=1 << 16)
def _shape(token: str) -> tuple[int, float]:
    """Characters of a token and the words it weighs: a character of a script without spaces half a one."""
    if not token[0].isalnum():
        return len(token), 0.0
    return (2, 0.5) if _WIDE.match(token) else (len(token), 1.0)


def measure(text: str | None) -> tuple[float, float, float, float, float]:
    """Mass of clauses, of what lies outside them, and of code and figures (in words); the share of the
    second covered by repeats; and the page's share of free neighbours."""
    tokens, segments, any_wide = read_page(text) if text and not text.isspace() else ([], [], False)
    if not segments:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    counts = Counter(tokens)
    counts["\n"] = 0
    # what occurs once, and the ends of segments, only cut the sequence
    number = {t: k for k, t in enumerate([t for t, n in counts.items() if n > 1])}
    symbols = list(map(number.get, tokens))
    automaton = SuffixAutomaton(symbols)
    # characters of a script without spaces return in pairs, words hardly do
    returns = [_WIDE.match(t) is not None for t in number] if any_wide else None

    after = {k: automaton.following[q] for k, q in automaton.following[0].items()} | {None: {}}
    turned = list(map(contains, map(after.get, symbols[1:]), symbols))  # known the other way round
    doubled = True in map(eq, tokens, tokens[1:])
    orders: list[tuple[int, int]] = []
    all_pairs = all_free = code_lines = 0
    lines: set[int] = set()
    items_of: Counter[int] = Counter()
    for kind, line, start, end in segments:
        lines.add(line)
        pairs = free = 0
        if kind == "running" or kind == "short":
            pairs = end - start - 1
            words = tokens[start:end]
            if len({*words}) > pairs or (not doubled and len({*pairwise(words)}) == pairs):  # no word or no pair twice
                free = sum(turned[start : end - 1])
            else:
                met = set()
                for i, pair in enumerate(pairwise(symbols[start:end]), start):
                    a, b = pair
                    if a is not None and b is not None:
                        free += turned[i] or a == b or pair in met
                        if returns is None or not returns[a]:
                            met.add(pair)
            all_pairs += pairs
            all_free += free
        elif kind == "code":
            code_lines += 1
        elif kind == "item":
            items_of[line] += 1
        orders.append((pairs, free))
    disorder = all_free / all_pairs if all_pairs else 0.0
    clause = [s[0] == "running" and free + PRIOR * disorder < FREE * (pairs + PRIOR) for s, (pairs, free) in zip(segments, orders)]
    clauses_of = Counter(s[1] for s, is_clause in zip(segments, clause) if is_clause) if items_of else {}
    mostly_code = code_lines >= CODE_LINES * len(lines)

    mass_to = [0.0, *accumulate([_shape(t)[1] for t in tokens])] if any_wide else []
    clauses = outside = other = 0.0
    apart: list[tuple[int, int]] = []
    for (kind, line, start, end), is_clause in zip(segments, clause):
        if kind == "head":
            continue
        if kind == "item" and tokens[start] == TAG:
            mass = float(len(_WORD.findall("".join(tokens[start:end]))))
        elif any_wide:
            mass = mass_to[end] - mass_to[start]
        else:
            mass = float(end - start - 2 * (kind == "item"))  # without the marks of an item
        if is_clause or (kind == "item" and items_of[line] <= 2 * clauses_of.get(line, 0)):
            clauses += mass
        elif kind == "code" or (mostly_code and kind != "item"):
            other += mass
        else:
            outside += mass
            apart.append((start, end))
    return clauses, outside, other, _coverage(tokens, automaton, apart, any_wide) if apart else 0.0, disorder


def _coverage(tokens: list[str], automaton: SuffixAutomaton, apart: list[tuple[int, int]], any_wide: bool) -> float:
    """Share of the characters of these parts of a page that repeats anywhere in it cover."""
    sizes = [_shape(t)[0] for t in tokens] if any_wide else list(map(len, tokens))
    size_to = [0, *accumulate(sizes)]
    repeated_to = [0, *accumulate(map(mul, covered_places(automaton.repeats(), size_to), sizes))]
    characters = sum(size_to[end] - size_to[start] for start, end in apart)
    return sum(repeated_to[end] - repeated_to[start] for start, end in apart) / characters if characters else 0.0


MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("clauses", "stuffed", "other", "coverage", "disorder")])


def page_measures(text: Column) -> Column:
    """Struct of the measures of :func:`measure`."""

    @F.arrow_udf(MEASURES)
    def measured(batch: pa.Array) -> pa.Array:
        rows = [measure(t) for t in batch.to_pylist()]
        columns = list(zip(*rows)) if rows else [[] for _ in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], [f.name for f in MEASURES])

    return measured(text)


def is_stuffed(stuffed: Column, coverage: Column, mass: Column, share: float = SHARE) -> Column:
    """The repeats outside clauses make up the share of the mass."""
    return (mass > 0) & (stuffed * coverage >= share * mass)


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """Pages (``doc_id``) that are cases, with their measures."""
    m = documents.select("doc_id", page_measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    return m.filter(is_stuffed(F.col("stuffed"), F.col("coverage"), F.col("clauses") + F.col("stuffed") + F.col("other")))
