"""Patterns of lines and words. They decide which lines are which.

White space is spelled out, so that it means the same (all Unicode white space)
to every engine that reads these patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

SPACES = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{SPACES}]"
#: The same within a line.
IN_LINE = SPACES.replace(r"\t-\r", r"\t\x{b}-\r")
L = f"[{IN_LINE}]"
#: The characters of SPACES themselves.
SPACE_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STRIP = rf"^{S}+|{S}+\z"
ROMAN_OR_DIGITS = "[IVXLCDM0-9]+"
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
MONTHS_CAPITAL = "January|February|March|April|May|June|July|August|September|October|November|December"


def whole(body: str) -> str:
    return rf"\A{S}*(?:{body}){S}*\z"


def prefix(body: str) -> str:
    return rf"\A{S}*(?:{body})"


def any_of(*rules: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + "(?:" + "|".join(rules) + ")"


def by_line(rule: str, guard: str = "") -> str:
    """A rule of a stripped line, anchored at its start, as a rule of a whole text that finds it in any of its lines.

    It finds at most one place a line, so that counting places counts lines.  ``guard`` is what every line that it takes
    begins with: most others are told by it.
    """
    return f"(?dm){_guarded(guard)}(?:{_in_lines(rule)})"


def _guarded(guard: str) -> str:
    return f"^(?={L}*+(?:{guard.replace(SPACES, IN_LINE)}))" if guard else ""


def _in_lines(rule: str) -> str:
    return rule.replace(SPACES, IN_LINE).replace(r"\A", f"^{L}*+").replace(r"\z", f"{L}*+$")


def whole_line(rule: str, anywhere: str | None = None, guard: str = "") -> str:
    """As ``by_line``, but finds the whole line; ``anywhere`` is a rule that may hold at any place of the line."""
    inner = f"{_guarded(guard)}(?:{_in_lines(rule)})" + (f"|^[^\n]*(?:{_in_lines(anywhere)})" if anywhere else "")
    return f"(?dm)(?:{inner})[^\n]*$"


@dataclass(frozen=True)
class Author:
    """Whose running heads are dropped and whose prefaces are kept."""

    first: str
    surname: str
    middle: str = ""

    @property
    def initials(self) -> str:
        return "".join(rf"{n[0]}\.?{S}*" for n in (self.first, self.middle) if n)

    @property
    def full(self) -> str:
        middle = rf"(?:{self.middle}{S}+)?" if self.middle else ""
        return rf"{self.first}{S}+{middle}{self.surname}"

    @property
    def either(self) -> str:
        return rf"(?:{self.initials}{self.surname}|{self.full})"


PAGE_NUMBER = whole("[0-9]{1,4}")
DASHED_NUMBER = rf"\A[-—]{S}*[0-9]+{S}*[-—]\z"
SERIES_TITLE = rf"THE{S}+COLLECTED{S}+WORKS"


def clean_header(author: Author | None = None) -> str:
    """Header or footer line of an extracted text; upper and lower case differ."""
    rules = [whole("[0-9]+"), DASHED_NUMBER, whole(rf"(?:chapter|part){S}+{ROMAN_OR_DIGITS}"), whole(SERIES_TITLE)]
    if author:
        rules += [whole(author.initials + author.surname.upper()), whole(rf"{author.first.upper()}{S}+{author.surname.upper()}")]
    return any_of(*rules, ignore_case=False)


def page_header(author: Author | None = None, series: str | None = None) -> str:
    """Header or footer line of a page, besides lines of fewer than three characters."""
    rules = [r"\A[0-9]{1,4}\z", DASHED_NUMBER, prefix(SERIES_TITLE), rf"\AVOLUME{S}+{ROMAN_OR_DIGITS}\z"]
    if author:
        rules.append(rf"\A{author.either}\z")
    if series:
        rules.append(prefix(series))
    return any_of(*rules)


TOC_LINE = any_of(
    rf"\A[IVXLCDM]+\.?\z",
    rf"\A[IVXLCDM]+\.?{S}+[0-9]{{1,2}}{S}+(?:{MONTHS})",
    rf"\A(?:chapter|part|section|lecture|seminar){S}+[0-9]+",
    r"\A[0-9]{1,4}\z",
    rf"\A(?:introduction|preface|foreword|acknowledgments?|bibliography|index|contents){S}*[ivxlcdm]*\z",
    rf"\A[A-Z][A-Z{SPACES}]{{2,30}}\z",
    rf"\A[0-9]{{1,2}}{S}+(?:{MONTHS}){S}+[0-9]{{4}}\z",
)

#: What lines of contents begin with: a short line's whole, or a word or number.
TOC_GUARD = (
    rf"[^\n]{{0,45}}{L}*+$|(?i:chapter|part|section|lecture|seminar|introduction|preface|foreword|acknowledgment|bibliography|index|contents)"
    rf"|(?i:[ivxlcdm]+\.?(?:{L}|$))|[0-9]{{1,2}}{L}"
)


def front_anywhere(publishers: tuple[str, ...] = ()) -> str:
    """What makes a line front matter wherever it stands in it; ``publishers`` are patterns of publishers' and series' names."""
    return any_of(*_FRONT_WORDS, *publishers)


_FRONT_WORDS = (
    "copyright",
    rf"all{S}+rights{S}+reserved",
    "isbn",
    rf"library{S}+of{S}+congress",
    rf"printed{S}+in{S}+(?:the{S}+)?(?:united|usa|u\.s)",
    rf"published{S}+by",
    rf"first{S}+(?:edition|printing|published)",
)


def front_somewhere(publishers: tuple[str, ...] = ()) -> str:
    """Whether a text has front matter anywhere: the rules behind their first letters, which pass over most places."""
    words = f"(?=[acfilpACFILP]){any_of(*_FRONT_WORDS)}"
    return any_of(words, *(any_of(p) for p in publishers), by_line(FRONT_START, FRONT_GUARD), ignore_case=False)


FRONT_GUARD = "(?i:ta|co|ac|me|li|bi|ch)"
FRONT_START = any_of(
    whole(rf"table{S}+of{S}+contents"),
    whole("contents"),
    whole("acknowledgments?"),
    whole(rf"members{S}+of{S}+the{S}+seminar"),
    whole(rf"list{S}+of{S}+(?:abbreviations|illustrations)"),
    whole(rf"bibliographical{S}+note"),
    prefix("chronolog(?:y|ical)"),
)


def front_matter(publishers: tuple[str, ...] = ()) -> str:
    return any_of(front_anywhere(publishers), FRONT_START, ignore_case=False)


BACK_HEADING = any_of(*(whole(x) for x in ("index", rf"subject{S}+index", rf"name{S}+index", rf"general{S}+index", "bibliography", rf"works{S}+cited")))

_NOTES = "(?:note|preface|introduction|foreword)"
SECTION_TO_REMOVE = any_of(
    *(
        whole(x)
        for x in (
            rf"table{S}+of{S}+contents?", "contents?", "inhalt", "index", rf"subject{S}+index", rf"name{S}+index",
            rf"general{S}+index", "foreword", rf"editor'?s?{S}+{_NOTES}", rf"translator'?s?{S}+{_NOTES}",
            rf"publisher'?s?{S}+note", rf"editorial{S}+note", "bibliography", "references", rf"works{S}+cited",
            rf"suggested{S}+reading", rf"further{S}+reading",
        )
    ),
    *(
        prefix(x)
        for x in (
            rf"appendix{S}*:{S}*chronolog", rf"appendix{S}*:{S}*bibliograph", rf"copyright{S}*©?{S}*[0-9]{{4}}",
            rf"all{S}+rights{S}+reserved", rf"isbn[{SPACES}:-]*[0-9-]+", rf"library{S}+of{S}+congress",
            rf"printed{S}+in{S}+(?:the{S}+)?(?:united{S}+states|usa|u\.s\.a\.|great{S}+britain|uk)", rf"published{S}+by{S}+",
            rf"first{S}+(?:published|edition|printing)",
        )
    ),
)
#: A preface or introduction by somebody: kept where it is the author's.
BY_SOMEBODY = any_of(prefix(rf"(?:introduction|preface){S}+by{S}+"))


def author_content(author: Author | None = None) -> str:
    rules = [prefix(rf"author'?s?{S}+(?:preface|foreword|note|introduction)")]
    if author:
        rules += [
            prefix(rf"(?:preface|foreword|introduction){S}+by{S}+{author.either}"),
            prefix(rf"{author.surname}'?s?{S}+(?:preface|foreword|note)"),
        ]
    return any_of(*rules)


#: The first letters of all rules of sections.
SECTION_BEGINS = (
    "table|content|inhalt|index|subject|name|general|foreword|editor|translator|publisher|bibliography|references|works|suggested|further|appendix|"
    "copyright|all|isbn|library|printed|published|first|introduction|preface|author|chapter|part|[0-9]"
)
SECTION_END = any_of(prefix(rf"(?:chapter|part){S}+{ROMAN_OR_DIGITS}"), prefix(rf"[0-9]+\.{S}+[A-Z]"))

HEADING_START = any_of(rf"\A(?:CHAPTER|PART|SECTION|LECTURE){S}+{ROMAN_OR_DIGITS}")
QUALITY_TOC = any_of(whole(rf"[IVXLCDM]+\.{S}*[0-9]+"), whole(rf"Chapter{S}+[0-9]+{S}*\.+{S}*[0-9]+"))
FRONT_WORDS = ("copyright", "isbn", "all rights reserved", "library of congress")
PAGE_REFERENCE = rf",{S}*[0-9]{{1,4}}(?:{S}*-{S}*[0-9]{{1,4}})?"

ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|Jr|Sr|vs|etc|i\\.e|e\\.g|vol|Vol|par|pars|cf|Cf"

#: Word pieces of the native token counter: runs of ASCII letters and digits, every other visible sign alone.
TOKEN = r"[A-Za-z0-9]+|[^ \t\n\r\f\x0bA-Za-z0-9]"

MARKER_WORDS = "CHAPTER|Chapter|PART|Part|SECTION|Section|LECTURE|Lecture|Seminar|To"
STANDARD_MARKER = rf"\A(CHAPTER|Chapter|PART|Part|SECTION|Section|LECTURE|Lecture){S}+({ROMAN_OR_DIGITS})[{SPACES}:.]*(.*)\z"
SEMINAR_MARKER = rf"\A(Seminar){S}+([0-9]+)[{SPACES}:.]*(.*)\z"
LETTER_MARKER = any_of(
    rf"\A[0-9]{{1,2}}{S}+(?:{MONTHS_CAPITAL}){S}+[0-9]{{4}}\z",
    rf"\A(?:{MONTHS_CAPITAL}){S}+[0-9]{{1,2}},?{S}+[0-9]{{4}}\z",
    rf"\ATo{S}+[A-Z][a-z]+(?:{S}+[A-Z][a-z]+)*{S}*\z",
    ignore_case=False,
)
ESSAY_MARKER = rf"\A[A-Z][A-Z{SPACES}]{{10,60}}\z"
ESSAY_EXCLUDED = "CHAPTER|PART|SECTION|LECTURE"
