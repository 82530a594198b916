"""Cells, labels and titles as columns: markup kinds, indents, dittos, arrows, jargon, claims, sizes on a page."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

# ---- fixed values --------------------------------------------------------------------------------
MARKS = (("hit", r"<hit>(.+?)</hit>"), ("safe", r"<safe>(.+?)</safe>"), ("hi", r"<hi>(.+?)</hi>"), ("b", r"(?<![\w*^])\*\*(.+?)\*\*(?!\*)"), ("i", r"(?<![\w*^])\*([^*\n]+?)\*"))
CODE = r"(?<!`)`(?!`)([^`\n]+?)(?<!`)`(?!`)"
DITTO = ("...", "…", "⋮", ":")
ACUITY = 200.0
EM = 0.55
PRONOUNS = "we|you|they|I"
AUXILIARIES = "am are be been being can could did do does done had has have is may might must shall should was were will would".split()
PLAIN_WORDS = ("n/a", "w/o", "w/", "i.e", "e.g")
ROMAN_NUMERAL = r"^[IVX]{2,4}$"
SIZE = r"(?i)^x?[0-9]+(?:x[0-9]+)*x?$"  # 3x3, x2
FORMULA_PART = r"^(?:[A-Za-z][-+]?[0-9]{1,3}|[0-9]{1,3}[-+]?[A-Za-z])$"  # x1, T-2, 3D
SPELLED = r"(?<![A-Za-z])([A-Za-z](?:[-\s][A-Za-z]){1,7})(?![A-Za-z])"
OVER = r"(?i)\b([A-Za-z0-9]{1,4})\s+over\s+([A-Za-z0-9]{1,4})\b"
SUB = r"(?i)\b([A-Za-z]{1,4})\s+sub\s+([A-Za-z0-9]{1,4})\b"
SETS_UP = r"(?i)^\s*(?:we\s+(?:denote|write|use)\b|let\b|here\b[^.]{0,20}\bdenotes?\b)"  # how sentences open that only set up notation
ABUSE = r"(?i)\babuse\s+of\s+notation\b"
SIGN = r"[_^|=\\{}()<>]|^[A-Za-z]$|^\W+$"
CONTRACTIONS = ((r"\b([Cc])an['’]t\b", "$1an not"), (r"\b([Ww])on['’]t\b", "$1ill not"), (r"\b([A-Za-z]+)n['’]t\b", "$1 not"), (r"\b([A-Za-z]+)['’](?:s|re|ve|ll|d|m)\b", "$1"))
STOP = "a an the of in on to for and or is are was were be been it its this that we our us you they them with at by as from than then so but not no".split()
# --------------------------------------------------------------------------------------------------

#: A lexicon of this library, in alphabetical order: verbs that talk titles use, and those whose past is not formed by rule.
REGULAR = """accept achieve adapt add adjust agree aim align allow amplify analyse annotate answer approach argue arrange arrive assign assume attract average balance behave benefit
block boost borrow bound bridge cancel capture carry cause challenge change check clarify classify cluster collapse collect combine compare compete compile complete compress compute
concentrate confirm connect conserve consist constrain control converge copy correct correlate count cover crash cross damage decay decide decline decrease define degrade delay deliver
depend describe detect determine differ disagree disappear discover divide dominate double drop eliminate emerge enable encode end enforce enter estimate evaluate evolve exceed exist
expand expect explain explode explore express fail filter finish fix flip follow force form function gain generalise generate guide handle happen help hurt identify ignore
improve include increase indicate influence inform interact introduce involve isolate jump justify label lack last launch learn limit link look lower maintain map mark mask match matter
measure merge minimise miss mix model move multiply need observe occur offer open operate optimise outlive outperform overlap pass peak perform persist pick place play point predict prefer
prevent produce promise protect prove provide pull push question raise rank reach react recover reduce refine reflect reject rely remain remove repeat replace report require
resist resolve respond reveal reverse reward rotate sample saturate save scale score search select separate serve share shift simplify slow solve sort start stay stop store stretch struggle
succeed suffer suggest support survive switch talk test track train transfer transform translate treat trigger turn understate update use validate vanish vary verify violate wait want warn work yield""".split()
STRONG_VERBS = {
    "beat": "beaten", "become": "became", "begin": "began begun", "bend": "bent", "bind": "bound", "break": "broke broken", "bring": "brought", "build": "built", "buy": "bought", "choose": "chose chosen",
    "come": "came", "cost": "", "cut": "", "deal": "dealt", "draw": "drew drawn", "drive": "drove driven", "fall": "fell fallen", "feed": "fed", "feel": "felt", "find": "found", "fit": "fitted", "fly": "flew flown",
    "forget": "forgot forgotten", "get": "got", "give": "gave given", "go": "went gone", "grow": "grew grown", "hide": "hid hidden", "hit": "", "hold": "held", "keep": "kept", "know": "knew known", "lead": "led",
    "leave": "left", "let": "", "lose": "lost", "make": "made", "mean": "meant", "meet": "met", "pay": "paid", "put": "", "read": "", "ride": "rode ridden", "rise": "rose risen", "run": "ran", "say": "said", "see": "saw seen",
    "sell": "sold", "send": "sent", "set": "", "shrink": "shrank shrunk", "show": "shown", "sink": "sank sunk", "sit": "sat", "speak": "spoke spoken", "spend": "spent", "split": "", "spread": "", "stand": "stood", "stick": "stuck",
    "take": "took taken", "teach": "taught", "tell": "told", "think": "thought", "throw": "threw thrown", "wear": "wore worn", "win": "won", "write": "wrote written",
}


def strip_markup(text: Column) -> Column:
    """Marks out, their text stays. Each pass takes off one layer at least, so there are as many passes as a text has
    marks that open: none for most."""

    def once(x: Column) -> Column:
        for _, pattern in MARKS:
            x = F.regexp_replace(x, f"(?s){pattern}", "$1")
        return F.regexp_replace(x, CODE, "$1")

    opening = F.regexp_count(text, F.lit(r"<(?:hit|safe|hi)>|\*+|`"))
    return F.aggregate(F.array_repeat(F.lit(0), opening), text, lambda x, _: once(x))


def cell_kind(text: Column) -> Column:
    """(kind, text): the first mark of a cell, null where there is none; code is no mark."""
    at = [F.struct(F.when(F.regexp_instr(text, F.lit(f"(?s){p}")) > 0, F.regexp_instr(text, F.lit(f"(?s){p}"))).alias("at"), F.lit(k).alias("kind")) for k, p in MARKS]
    first = F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))
    return F.struct(first["kind"].alias("kind"), strip_markup(text).alias("text"))


def emphasised(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern in MARKS:
        out = out | text.rlike(f"(?s){pattern}")
    return F.coalesce(out, F.lit(False))


def indent(text: Column) -> Column:
    """(level, text): two leading spaces are a level."""
    bare = F.ltrim(F.coalesce(text, F.lit("")))
    spaces = F.length(F.coalesce(text, F.lit(""))) - F.length(bare)
    return F.struct(F.floor((spaces + 1) / 2).cast("int").alias("level"), bare.alias("text"))


def is_ditto(text: Column) -> Column:
    return F.trim(strip_markup(F.coalesce(text, F.lit("")))).isin(*DITTO)


def is_group_row(cells: Column) -> Column:
    """The first cell is filled and all others are blank."""
    return (F.size(cells) > 1) & (F.trim(F.get(cells, F.lit(0))) != "") & F.forall(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.trim(c) == "")


def arrows(text: Column) -> Column:
    """-> and --> as one sign, and their mirror images."""
    return F.regexp_replace(F.regexp_replace(text, "(?<![-<>=])-{1,2}>", "→"), "<-{1,2}(?![-<>=])", "←")


def uncontracted(text: Column) -> Column:
    for pattern, to in CONTRACTIONS:
        text = F.regexp_replace(text, pattern, to)
    return text


def stem(word: Column) -> Column:
    """The roughest stem: one ending, a last e."""
    cut = F.regexp_replace(word, "^(.{3,}?)(?:ing|ed|es|s)$", "$1")
    return let(cut, lambda w: F.when((F.length(w) > 3) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def content_words(text: Column) -> Column:
    """Stems of a text's words without the common ones, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0))
    return F.transform(F.filter(words, lambda w: ~w.isin(STOP)), lambda w: stem(w))


def is_jargon(word: Column) -> Column:
    """Words an audience may not know, told by their shape: two capitals, digits among letters, or a short slash.

    No jargon: one sign, common words, Roman numerals, sizes (3x3, x2) and parts of formulas (x1, T-2, 3D).
    """
    known = (F.length(word) < 2) | F.lower(word).isin(*STOP, *PLAIN_WORDS) | word.rlike(ROMAN_NUMERAL) | word.rlike(SIZE) | word.rlike(FORMULA_PART)
    mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
    return ~known & (mixed | (F.regexp_count(word, F.lit("[A-Z]")) >= 2) | (F.contains(word, F.lit("/")) & (F.length(word) <= 6)))


def spoken_forms(text: Column) -> Column:
    """What spelled-out abbreviations look like on screen: E-x-M-y, b over c, x sub i."""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    letters = F.transform(found(SPELLED, 1), lambda x: F.regexp_replace(x, r"[-\s]", ""))
    pair = lambda pattern, sign: F.transform(found(pattern, 0), lambda x: F.regexp_replace(x, pattern, f"$1{sign}$2"))
    return F.concat(letters, pair(OVER, "/"), pair(SUB, "_"))


def verb_forms(base: str) -> set[str]:
    """A verb's regular forms by spelling: added endings, a silent e, y after a consonant, a doubled last letter."""
    vowels = "aeiou"
    if base.endswith("e"):
        return {base, base + "s", base + "d", base[:-1] + "ing"}
    if base.endswith("y") and base[-2:-1] not in vowels:
        return {base, base[:-1] + "ies", base[:-1] + "ied", base + "ing"}
    stem = base + base[-1] if len(base) <= 4 and base[-1] in "tpgnm" and base[-2:-1] in vowels and base[-3:-2] not in vowels else base
    return {base, base + ("es" if base.endswith(("s", "x", "sh", "ch", "o")) else "s"), stem + "ed", stem + "ing"}


def verb_set(verbs: list[str] | None = None) -> list[str]:
    """All forms of the given verbs, or of this library's; auxiliaries always."""
    regular = set().union(*map(verb_forms, verbs if verbs is not None else REGULAR))
    strong = {f for base, past in ({} if verbs is not None else STRONG_VERBS).items() for f in (base, *past.split(), *(x for x in verb_forms(base) if x.endswith(("s", "ing"))))}
    return sorted(regular | strong | set(AUXILIARIES))


def is_claim(title: Column, verbs: list[str] | None = None) -> Column:
    """Whether a title says something, by its number of words: six or more do; three to five with a verb or a pronoun's
    clause; two if the first is a verb, or the second and a full stop; one verb with a full stop. `verbs`: base forms."""
    words = F.transform(F.regexp_extract_all(title, F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0)), F.lower)
    is_verb, n = F.transform(words, lambda w: w.isin(*verb_set(verbs))), F.size(words)
    ends = title.rlike(r"[.!]\s*$")
    return F.coalesce(
        F.when(n >= 6, True)
        .when(n >= 3, F.array_contains(is_verb, True) | title.rlike(rf"\b(?:{PRONOUNS})\s+[A-Za-z]"))
        .when(n == 2, F.get(is_verb, F.lit(0)) | (F.get(is_verb, F.lit(1)) & ends))
        .when(n == 1, F.get(is_verb, F.lit(0)) & ends),
        F.lit(False),
    )


def is_question(text: Column) -> Column:
    return F.coalesce(F.rtrim(text).endswith("?"), F.lit(False))


def opens_with_conjunction(title: Column) -> Column:
    """A title that goes on from the one before: and, but, so, because, or which where it asks nothing."""
    return F.coalesce(title.rlike(r"(?i)^(?:and|but|so|because)\b") | (title.rlike(r"(?i)^which\b") & ~is_question(title)), F.lit(False))


def notation_only(text: Column) -> Column:
    """A sentence that only sets up symbols: it owns up to an abuse of notation, or opens by setting up and two tokens in
    five at least are signs."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    signs = F.size(F.filter(tokens, lambda x: x.rlike(SIGN)))
    return text.rlike(ABUSE) | (text.rlike(SETS_UP) & (10 * signs >= 4 * F.greatest(F.size(tokens), F.lit(1))))


def language(text: Column) -> Column:
    """ko where more than half of the letters are Hangul, or there are no letters at all; else en."""
    hangul, letters = F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z가-힣]"))
    return F.when((hangul * 2 > letters) | (letters == 0), "ko").otherwise("en")


def clip(text: Column, n: int) -> Column:
    """At most n characters: up to the last sentence end, else the last word, and an ellipsis."""
    head = F.substring(text, 1, n)
    sentence, word = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1), F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= n, text).when(sentence != "", sentence).otherwise(F.concat(F.when(word != "", word).otherwise(head), F.lit("…")))


def text_width(text: Column, points: Column, bold: bool = False) -> Column:
    """Inches of a line, estimated generously from its length."""
    return F.length(text) * points * (0.60 if bold else EM) / 72.0


def least_cap_percent(viewing_ratio: Column) -> Column:
    return 100.0 * viewing_ratio / ACUITY


def snapped(values: Column, unit: float) -> Column:
    """Coordinates nearer than a unit to one kept before become that one; a fold in order. Equal ones go one way, so the fold
    is over distinct ones and holds only those kept."""
    near = lambda v: lambda w: F.abs(w - v) < unit
    keep = lambda out, v: F.when(F.coalesce(F.exists(out, near(v)), F.lit(False)), out).otherwise(F.concat(out, F.array(v.cast("double"))))
    kept = F.aggregate(F.array_distinct(values), F.array().cast("array<double>"), keep)
    return F.get(F.transform(F.array(kept), lambda k: F.transform(values, lambda v: F.coalesce(F.get(F.filter(k, near(v)), F.lit(0)), v.cast("double")))), F.lit(0))


def heading(title: Column, lead: Column, values: Column, gap: str = "vs") -> Column:
    """What names a slide: its title, else its lead, else its values side by side."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(lead, F.lit("")), F.array_join(values, f" {gap} "))


def uncountable(text: Column) -> Column:
    """There are signs, but neither words nor syllables to count."""
    return (F.regexp_replace(text, r"\s", "") != "") & ~text.rlike("[A-Za-z0-9가-힣぀-ヿ一-鿿]")


def omitted(text: Column) -> Column:
    """A list of values to leave out: parted by semicolons, or else by commas, but a comma between digits that can part
    thousands stays."""
    parts = lambda sign: F.filter(F.transform(F.split(text, sign), lambda x: F.trim(x)), lambda x: x != "")

    def join(out: Column, part: Column) -> Column:
        last = F.element_at(out, -1)
        goes_on = (F.size(out) > 0) & F.trim(part).rlike("^[0-9]{3}$") & F.trim(last).rlike("^[0-9]{1,3}(?:,[0-9]{3})*$")
        return F.when(goes_on, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(last, F.lit(","), part)))).otherwise(F.concat(out, F.array(part)))

    joined = F.aggregate(F.split(text, ","), F.array().cast("array<string>"), join)
    return F.when(F.contains(text, F.lit(";")), parts(";")).otherwise(F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x != ""))


def font_family(name: Column) -> Column:
    """A font's family: no subset prefix (ABCDEF+), no style behind a hyphen or comma, no trailing weight."""
    plain = F.regexp_replace(F.regexp_replace(name, r"^[A-Z]{6}\+", ""), r"[-,].*$", "")
    return F.regexp_replace(plain, r"(?:PS)?(?:MT)?$", "")
