"""Nested grammar that regular expressions cannot read: braces, macros, toggles, math, number words.

Each is a plain function of one text and a Pandas UDF around it; texts that a function could not change skip Python.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values --------------------------------------------------------------------------------
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
GREEK = {w: c for w, c in zip("alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi chi psi omega Delta Sigma Omega".split(), "αβγδεθλμπρστφχψωΔΣΩ")}
SYMBOLS = {"times": "×", "pm": "±", "approx": "≈", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "to": "→", "rightarrow": "→", "cdot": "·", "infty": "∞", "textminus": "−", "neq": "≠", "ldots": "…", "dots": "…"}
ACCENTS = {
    "'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307",
    "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a",
}
LETTERS = {"i": "ı", "o": "ø", "O": "Ø", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł"}
BARE_MARKS = "'`\"~="  # of the marks, those that a letter may follow without braces
SUPERSCRIPT = str.maketrans("0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ")
SUBSCRIPT = str.maketrans("0123456789+-", "₀₁₂₃₄₅₆₇₈₉₊₋")
# --------------------------------------------------------------------------------------------------


HELD = 0xF0000  # private signs that stand for escaped ones while a text is worked on


def closing(text: str, at: int) -> int:
    """Behind the brace that closes the one at `at`; the end if none does. Escaped braces do not count."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        depth += (c == "{") - (c == "}")
        i += 1
        if not depth:
            return i
    return len(text)


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """The brace groups that follow `at`, options in brackets skipped, and where they end."""
    out = []
    while True:
        m = re.compile(r"\s*(?:\[[^\]]*\]\s*)?").match(text, at)
        if m.end() >= len(text) or text[m.end()] != "{":
            return out, at
        end = closing(text, m.end())
        out.append(text[m.end() + 1 : end - 1 if end <= len(text) and text[end - 1 : end] == "}" else end])
        at = end


def commands(text: str, names) -> list[tuple[int, int, list[str]]]:
    """(start, end, arguments) of every use of the named commands, outermost ones only."""
    out, at = [], 0
    for m in re.finditer(r"\\(" + "|".join(map(re.escape, names)) + r")\*?(?![A-Za-z])", text):
        if m.start() >= at:
            args, at = arguments(text, m.end())
            at = max(at, m.end())
            out.append((m.start(), at, args))
    return out


def without_commands(text: str, names, keep: bool = False) -> str:
    """The named commands and their arguments out of the text; with `keep` the last argument stays."""
    out, at = [], 0
    for start, end, args in commands(text, names):
        out.append(text[at:start])
        if keep and args:
            out.append(without_commands(args[-1], names, keep))
        at = end
    return "".join([*out, text[at:]])


def captions(text: str) -> list[str]:
    return [args[-1] for _, _, args in commands(text, ["caption"]) if args]


def without_comments(text: str) -> str:
    return re.sub(r"\\iffalse\b.*?(?:\\fi\b|\Z)", "", re.sub(r"(?<!\\)%[^\n]*", "", text), flags=re.S)


def with_macros(text: str, passes: int = 2) -> str:
    """Commands without arguments that the text defines, put in their place; definitions go."""
    found = {}
    for m in re.finditer(r"\\(?:newcommand|renewcommand|providecommand|def)\*?\s*\{?\\([A-Za-z]+)\}?(?=\s*\{)", text):
        args, end = arguments(text, m.end())
        if args:
            found.setdefault(m[1], []).append((m.start(), end, args[0]))
    for spans in found.values():
        for start, end, _ in spans:
            text = text[:start] + " " * (end - start) + text[end:]
    for _ in range(passes if found else 0):
        text = re.sub(r"\\(" + "|".join(sorted(found, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\})?", lambda m: found[m[1]][-1][2], text)
    return text


def with_toggles(text: str, state: dict[str, bool] | None = None) -> str:
    """\\iftoggle{x}{a}{b} by the last \\toggletrue or \\togglefalse before it, outside or inside the branch it stands in.

    What a branch that is kept sets holds behind it too; \\newtoggle sets false."""
    state, out, at = {} if state is None else state, [], 0
    for m in re.finditer(r"\\(newtoggle|toggletrue|togglefalse|iftoggle)(?![A-Za-z])", text):
        if m.start() < at:
            continue
        args, end = arguments(text, m.end())
        if m[1] != "iftoggle":
            if args:
                state[args[0]] = m[1] == "toggletrue"
            continue
        if len(args) >= 3:
            out += [text[at : m.start()], with_toggles(args[1] if state.get(args[0]) else args[2], state)]
            at = end
    return "".join([*out, text[at:]])


_ACCENT = re.compile(r"""(?P<open>\{)?\\(?:
    (?P<mark>['`^"~=.])\s*(?:\{(?P<inner>[A-Za-z])\}|(?P<bare>[A-Za-z]))   # \'e  \'{e}
    | (?P<name>[uvHckr])\s*\{(?P<under>[A-Za-z])\}                       # \c{c}, but neither \cite{c} nor \c c
    | (?P<letter>ss|ae|AE|oe|OE|aa|AA|[ioOlL])(?![A-Za-z])               # {\ss}
    )(?(open)\})""", re.X)  # fmt: skip


def with_accents(text: str) -> str:
    """Accent commands as letters, composed; a pair of braces right around one goes with it, all other commands stay."""

    def letter(m) -> str:
        closed = m["open"] is not None
        if m["letter"]:
            return LETTERS[m["letter"]] if closed or len(m["letter"]) == 2 else m[0]
        if m["bare"] and not closed and m["mark"] not in BARE_MARKS:
            return m[0]
        plain = m["inner"] or m["bare"] or m["under"]
        return unicodedata.normalize("NFC", plain + ACCENTS[m["mark"] or m["name"]])

    return _ACCENT.sub(letter, text)


def math_text(text: str) -> str:
    """Formulas as text: Greek letters, symbols, fractions, sub- and superscripts; escaped signs stand for themselves."""
    text = re.sub(r"\\([&%_$#{}^])", lambda m: chr(HELD + ord(m[1])), text)
    before = None
    while text != before:  # each pass takes the innermost ones
        before = text
        text = re.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2", text)
        text = re.sub(r"\\(?:text|mathrm|mathbf|mathit|operatorname|textbf|emph)\s*\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\([A-Za-z]+)", lambda m: GREEK.get(m[1]) or SYMBOLS.get(m[1]) or " ", text)
    text = re.sub(r"\^\s*(?:\{([^{}]*)\}|(\S))", lambda m: (m[1] or m[2]).translate(SUPERSCRIPT), text)
    text = re.sub(r"_\s*(?:\{([^{}]*)\}|(\S))", lambda m: (m[1] or m[2]).translate(SUBSCRIPT), text)
    text = re.sub(r"\s+", " ", re.sub(r"[{}$]", "", text)).strip()
    return re.sub(f"[{chr(HELD)}-{chr(HELD + 127)}]", lambda m: chr(ord(m[0]) - HELD), text)


_WORD = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]+(?![A-Za-z0-9_])")
_NUMBER = "|".join([*UNITS, *TENS])


def number_words(text: str) -> str:
    """Spelled numbers up to 999 as digits, and percent behind digits as %: "forty-nine", "three hundred and twelve".

    Words are read one by one: tens may have a unit, a number below a hundred may be followed by hundred, that by another
    number. Neighbouring numbers stay apart: "one two" is "1 2", "five and six" is "5 and 6".
    """
    words = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]
    name = lambda i: words[i][2] if i < len(words) else ""
    gap = lambda i: text[words[i][1] : words[i + 1][0]]  # noqa: E731  between word i and the next

    def small(i: int) -> tuple[int, int]:
        """(value, words) of the number below a hundred that begins at word i; no words if there is none."""
        if name(i) in UNITS:
            return UNITS.index(name(i)), 1
        if name(i) not in TENS:
            return 0, 0
        more = name(i + 1) in UNITS[1:10] and re.fullmatch(r"[-\s]+", gap(i))
        return TENS[name(i)] + (UNITS.index(name(i + 1)) if more else 0), 2 if more else 1

    out, at, i = [], 0, 0
    while i < len(words):
        value, used = small(i)
        if not used:
            i += 1
            continue
        if name(i + used) == "hundred" and gap(i + used - 1).isspace():
            value, used = value * 100, used + 1
            skip = 1 if name(i + used) == "and" and gap(i + used - 1).isspace() else 0
            rest, more = small(i + used + skip)
            if more and all(gap(j).isspace() for j in range(i + used - 1, i + used + skip)):
                value, used = value + rest, used + skip + more
        out += [text[at : words[i][0]], str(value)]
        at, i = words[i + used - 1][1], i + used
    return re.sub(r"(\d)\s*(?:percent|per\s+cent)\b", r"\1%", "".join([*out, text[at:]]), flags=re.I)


def clean_prose(text: str) -> str:
    """What a reader reads: no comments, math, floats, references, lengths or commands."""
    text = without_comments(text)
    text = re.sub(r"\\begin\{(equation|align|figure|table|tabular|verbatim|lstlisting|tikzpicture)\*?\}.*?\\end\{\1\*?\}", " ", text, flags=re.S)
    text = re.sub(r"\$\$.*?\$\$|\\\[.*?\\\]|(?<!\\)\$[^$]*(?<!\\)\$", " ", text, flags=re.S)
    text = without_commands(text, ["cite", "citep", "citet", "ref", "eqref", "label", "vspace", "hspace", "includegraphics", "bibliography", "footnote"])
    text = without_commands(text, ["textbf", "emph", "textit", "section", "subsection", "paragraph", "title", "caption"], keep=True)
    text = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?", " ", re.sub(r"\\([&%_$#{}])", r"\1", text))
    return re.sub(r"[ \t]+", " ", re.sub(r"[{}~]", " ", text)).strip()


def wrap_count(text: Column, width: int) -> Column:
    """Lines that greedy word wrap needs at so many characters; a longer word breaks."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))

    def place(s: Column, w: Column) -> Column:
        n = F.length(w)
        fits = (s["used"] > 0) & (s["used"] + 1 + n <= width)
        on = F.struct(s["lines"].alias("lines"), (s["used"] + 1 + n).alias("used"))
        tail = F.when(n % width == 0, F.lit(width)).otherwise(n % width)
        return F.when(fits, on).otherwise(F.struct((s["lines"] + F.greatest(F.lit(1), F.ceil(n / width).cast("int"))).alias("lines"), F.when(n <= width, n).otherwise(tail).alias("used")))

    return F.aggregate(words, start, place, lambda s: s["lines"])


def balanced_lines(text: Column, lines: int) -> Column:
    """The text's words on at most so many lines, so that the widest is as narrow as can be; filled from the first line.

    Greedy filling needs fewer lines the wider they are, so the least width among those of all runs of words that does
    with `lines` is the least possible; greedy filling at that width gives the lines."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    sizes = F.transform(words, F.length)
    run = lambda w, i, j: F.aggregate(F.slice(w, i, j - i + 1), F.lit(0), lambda n, x: n + x) + j - i  # noqa: E731  words i to j with spaces between
    widths = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda i: F.transform(F.sequence(i, F.size(sizes)), lambda j: run(sizes, i, j)))))

    def needed(width: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"))
        put = lambda s, z: F.when((s["n"] > 0) & (s["used"] + 1 + z <= width), F.struct(s["n"].alias("n"), (s["used"] + 1 + z).alias("used"))).otherwise(F.struct((s["n"] + 1).alias("n"), z.alias("used")))
        return F.aggregate(sizes, start, put, lambda s: s["n"])

    # no line is narrower than the longest word
    width = F.array_min(F.filter(widths, lambda w: (w >= F.array_max(sizes)) & (needed(w) <= lines)))

    def fill(out: Column, word: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (F.size(out) > 0) & (F.length(last) + 1 + F.length(word) <= width)
        return F.when(fits, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(out, F.array(word)))

    return F.when(F.size(words) > 0, F.aggregate(words, F.array().cast("array<string>"), fill)).when(text.isNotNull(), F.array().cast("array<string>"))


def bib_entries(text: str) -> list[tuple[str, str, str, str]]:
    """(kind, key, authors, year) of the entries of a .bib text; values stand in balanced braces, quotes or bare."""
    out = []
    for m in re.finditer(r"(?:^|\n)[ \t]*@([A-Za-z]+)\s*\{\s*([^,\s}]*)\s*,", text):
        start = text.index("{", m.start())
        body, fields, at = text[m.end() : closing(text, start) - 1], {}, 0
        while name := re.compile(r"[\s,]*([A-Za-z]+)\s*=\s*").match(body, at):
            at = name.end()
            if body[at : at + 1] == "{":
                end = closing(body, at)
                value = body[at + 1 : end - 1]
            elif body[at : at + 1] == '"':
                end = at + 1
                while end < len(body) and body[end] != '"':
                    end = closing(body, end) if body[end] == "{" else end + 1 + (body[end] == "\\")
                value, end = body[at + 1 : end], end + 1
            else:
                end = re.compile(r"[^,]*").match(body, at).end()
                value = body[at:end].strip()
            fields.setdefault(name[1].lower(), re.sub(r"\s+", " ", value).strip())
            at = end
        out.append((m[1].lower(), m[2], fields.get("author", ""), re.sub(r"\D", "", fields.get("year", ""))))
    return out


def _apply(f, kind: str = "string"):
    """A text function as a column function; null stays null."""

    def column(text: Column, *args) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x, *args))

        return run(text)

    return column


def _where(f, pattern: str, kind: str = "string"):
    """Only texts in which the pattern is found, the others cannot change, go through Python."""
    slow = _apply(f, kind)
    return lambda text, *args: F.when(text.rlike(pattern), slow(text, *args)).otherwise(text)


drop_commands = _where(without_commands, r"\\")
strip_comments = _where(without_comments, r"[\\%]")
expand_macros = _where(with_macros, r"\\")
resolve_toggles = _where(with_toggles, r"\\")
fold_accents = _where(with_accents, r"\\")
prose = _where(clean_prose, r"[\\$%{}~]|[ \t]{2}|\t|^\s|\s$")
math_to_text = _where(math_text, r"[\\$^_{}]|\s{2}|[\t\n\r\f\x0B]|^\s|\s$")
digits_for_words = _where(number_words, rf"(?i)(?<![A-Za-z0-9_])(?:{_NUMBER})(?![A-Za-z0-9_])|[0-9]\s*per\s*cent")
caption_list = _apply(captions, "array<string>")
bib_list = _apply(lambda text: [dict(zip(("kind", "key", "authors", "year"), e)) for e in bib_entries(text)], "array<struct<kind:string,key:string,authors:string,year:string>>")
