"""Scalar text functions as column expressions: values, tokens, sentences, normal forms, spoken counts.

What stands beside a token is looked at, not consumed, so neighbours do not hide each other. Values stay strings: 12.3
and 12.30 differ.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values --------------------------------------------------------------------------------
DECIMAL = r"(?<![A-Za-z0-9_.])([0-9]{1,4}\.[0-9]+)"  # in derived text: no letter, digit or dot before
SOURCE_DECIMAL = r"(?<![0-9.])([0-9]{1,4}\.[0-9]+)"  # in a source: letters may stand before
INTEGER = r"(?<![A-Za-z0-9_.,])([0-9]{2,})"
SOURCE_INTEGER = r"(?<![0-9.])([0-9]{2,})"
GROUP_SIGN = r"(?<=[0-9])(?:,|\x{2009}|\x{202F}|\\,)(?=[0-9]{3}(?![0-9]))"  # 19,559 and 203\,000, also with thin spaces
SPACED_GROUPS = r"(?<![0-9.,])[0-9]{2,3}(?: [0-9]{3})+(?![0-9.,])"  # 203 000
ALPHA_WORD = r"[A-Za-z][A-Za-z\-]{3,}"
WORD_RUN = r"[a-z0-9]+"
ABBREVIATIONS = "i\\.e|e\\.g|et al|etc|vs|cf|resp|approx|figs|fig|eqs|eq|sec|no|U\\.S|U\\.K|Tab|Dr|Mr|Ms"
WHY = r"because|so that|therefore|thus|hence|otherwise|in order to|the reason|this is why|that is why|follows from|denotes?|refers? to|is defined as|we call|means? that"
HEDGE = r"may|might|could|often|usually|typically|generally|largely|mostly|some|up to|roughly|approximately|comparable|suggests?|appears?|plans? to|seems?|likely|potentially|possibly|perhaps|partially|partly|slightly|competitive|nearly|close to|we observe|in practice|so far"
STRONG = r"always|never|every|entirely|completely|fully|guarantee[sd]?|prove[sd]?|proof|best|outperforms?|beats?|superior|significantly|dramatically|universally|cannot|impossible|must|solves?"
CAVEAT = r"(?:should|must|can|could)\s*not\s+be\s+compared|not\s+(?:directly\s+)?comparable|incomparable|do\s+not\s+compare"
NEGATION = r"not|no|nor|neither|never"
TOPIC_STOP = """result results value values model models test tests case cases number numbers point points setting settings change changes
report reports show shows give gives make makes take takes apply applies use uses used using each every other same both more most only just also
than then where when what which this that these those with from into over under about across between within while after before""".split()
STOP_WORDS = "the a an of to in on for and or with by is are was were be been this that it its as at from".split()
SYMBOL_WORDS = {"%": 1, "≈": 1, "×": 1, "±": 3, "≤": 2, "≥": 2, "→": 1}
# Java looks a class up in a table where its signs are listed one by one; ranges are asked one after the other
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALNUM, NO_SIGN = LETTERS + DIGITS, "[" + "".join(rf"\x{i:02x}" for i in range(128) if chr(i) not in SYMBOL_WORDS) + "]+"
TOKEN, PART = rf"[{ALNUM}](?:[{ALNUM}'’.\-]*[{ALNUM}'’\-])?", rf"[{ALNUM}](?:[{ALNUM}'’.]*[{ALNUM}'’])?"
NUMBER, ORDINAL = r"^[0-9]+(?:\.[0-9]+)?$", "(?:[sS][tT]|[nN][dD]|[rR][dD]|[tT][hH])"
# all parts, once ’ is '; the group has those that are a number, with its unit
NUMBERS = rf"([0-9]+(?:\.[0-9]+)?(?:(?!{ORDINAL}(?![{LETTERS}]))[{LETTERS}]{{1,3}}(?![{LETTERS}]))?){ORDINAL}?\.*(?![{ALNUM}'.])|[{ALNUM}][{ALNUM}'.]*"
UNIT, FRACTION, LONG_WHOLE = f"[{LETTERS}]+", r"\.[0-9]+", r"(?:^| )([0-9]{3,})"  # of such numbers, between spaces
MINUS, GREEK_LETTER = r"[-−](?<![\p{L}\p{N}_.][-−])(?=[0-9])", "[Α-Ωα-ω]"
SUFFIXES = ("ences", "ence", "ances", "ance", "ments", "ment", "ness", "ities", "ity", "ations", "ation", "ally", "ly")
ENDINGS = ("ing", "ed", "es", "s")
IRREGULAR = {
    "kept": "keep", "held": "hold", "led": "lead", "left": "leave", "lost": "lose", "made": "make", "meant": "mean", "ran": "run", "rose": "rise",
    "risen": "rise", "shown": "show", "seen": "see", "saw": "see", "taken": "take", "took": "take", "gave": "give", "given": "give", "found": "find",
    "fell": "fall", "fallen": "fall", "grew": "grow", "grown": "grow", "knew": "know", "known": "know", "went": "go", "gone": "go", "brought": "bring",
    "built": "build", "chose": "choose", "chosen": "choose", "drove": "drive", "driven": "drive", "spent": "spend", "split": "split", "stood": "stand",
    "told": "tell", "thought": "think", "won": "win", "wrote": "write", "written": "write", "broke": "break", "broken": "break", "began": "begin",
    "begun": "begin", "sent": "send",
}
CJK = "[가-힣぀-ヿ一-鿿]"
QUOTE_GAP = r"[^a-z0-9'\x{00C0}-\x{024F}\x{AC00}-\x{D7A3}]+"
CUT = r"\[\s*\.\.\.\s*\]|\.\.\.|\x{2026}"  # where a quotation leaves something out
WORDS_PER_MINUTE, SYLLABLES_PER_SECOND = 135, 5.0
# --------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once a row, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_word(alternatives: str) -> str:
    """A pattern that finds any of the alternatives as whole ASCII words, in any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """Distinct matches in order of their first occurrence; an empty array for null."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>")))


def decimals(text: Column) -> Column:
    return found(text, DECIMAL)


def source_decimals(text: Column) -> Column:
    return found(text, SOURCE_DECIMAL)


def integers(text: Column) -> Column:
    return found(flat_thousands(text), INTEGER)


def flat_thousands(text: Column) -> Column:
    """Numbers without the signs that part their thousands: 19,559, 203\\,000, thin spaces; 203 000 where two or three
    digits come first."""
    text = F.regexp_replace(text, GROUP_SIGN, "")
    parts = F.split(F.regexp_replace(text, f"({SPACED_GROUPS})", "\u0001$1\u0001"), "\u0001")
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "")
    return F.when(text.rlike(SPACED_GROUPS), joined).otherwise(text)


def alpha_words(text: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ALPHA_WORD), F.lit(0)), F.lower))


def word_run(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD_RUN), F.lit(0))


def topic_words(words: Column) -> Column:
    return F.filter(words, lambda w: (F.length(w) > 4) & ~w.isin(TOPIC_STOP))


def shingles(words: Column, k: int) -> Column:
    """All runs of k neighbours, joined by spaces; none where there are fewer words (sequence() would count down)."""
    none = F.array().cast("array<string>")
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(none))


def sentences(text: Column) -> Column:
    """Split behind . ! ? before white space; the dots of abbreviations do not count."""
    held = F.regexp_replace(text, rf"(?i)(^|[^A-Za-z0-9_])({ABBREVIATIONS})\.", "$1$2\u0001")
    parts = F.split(F.regexp_replace(held, r"([.!?])[ \t\n\r\f\x0B]+", "$1\u0002"), "\u0002")
    clean = F.transform(parts, lambda s: F.replace(F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " ")), F.lit("\u0001"), F.lit(".")))
    return F.filter(clean, lambda s: s != "")


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def normal_quote(text: Column) -> Column:
    """Lower case, one apostrophe, everything else but digits and Latin or Hangul letters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "’‘", "''")), QUOTE_GAP, " "))


def despaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", "")


def masked_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def folded(word: Column) -> Column:
    """A rough stem for comparison: case, hyphens, irregular forms, -ies, -ably, one noun or adverb suffix, one ending, a
    last e."""
    irregular = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    steps = (
        lambda w: F.coalesce(F.try_element_at(irregular, w), w),
        lambda w: F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).otherwise(w),
        lambda w: F.when((F.length(w) > 6) & (w.endswith("ably") | w.endswith("ibly")), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("e"))).otherwise(w),
        lambda w: F.regexp_replace(w, "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$", "$1"),
        lambda w: F.regexp_replace(w, "^(.{3,}?)(?:" + "|".join(ENDINGS) + ")$", "$1"),
        lambda w: F.when((F.length(w) > 3) & w.endswith("e"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w),
    )
    out = F.regexp_replace(F.lower(word), "[-/]", "")
    for step in steps:
        out = let(out, step)
    return out


def _below_thousand(n: Column) -> Column:
    return F.when(n < 100, 1).otherwise(3)


def integer_words(n: Column) -> Column:
    """Words a whole number below 10^12 takes when read aloud.

    Below 100 one, below 1000 three ("five hundred and five"); 1000-2099 like a year and round hundreds below 10,000 two;
    others group by group: each group's words and, but for the last, its unit.
    """
    groups = []
    for unit, name in ((10**9, 1), (10**6, 1), (10**3, 1), (1, 0)):
        g = F.floor(n / unit) % 1000
        groups.append(F.when(g > 0, _below_thousand(g) + name).otherwise(0))
    # what is left below a larger unit is read as a number of its own: 12,001,916 ends like the year 1916
    low = n % 1000000
    short = (low < 10000) & (low >= 1000) & (low % 1000 != 0) & ((low <= 2099) | (low % 100 == 0))
    tail = F.when(short, 2).otherwise(groups[2] + groups[3])
    return F.when(n < 100, 1).when(n < 1000, 3).when(n < 10**6, tail).otherwise(groups[0] + groups[1] + tail).cast("long")


def syllables(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK))


def digits_words(digits: Column) -> Column:
    """Words of a number given as digits, however many: groups of nine from the right, each but the last with its unit."""
    padded = F.lpad(digits, (F.ceil(F.length(digits) / 9) * 9).cast("int"), F.lit("0"))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.length(padded) / 9).cast("int") - 1), lambda i: F.substring(padded, i * 9 + 1, F.lit(9)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("on"))

    def add(s: Column, g: Column) -> Column:
        words = F.when(s["on"], 1 + F.when(g > 0, integer_words(g)).otherwise(0)).when(g > 0, integer_words(g)).otherwise(0)
        return F.struct((s["n"] + words).cast("long").alias("n"), (s["on"] | (g > 0)).alias("on"))

    return F.when(F.length(digits) <= 9, let(digits.cast("long"), integer_words)).otherwise(F.aggregate(groups, start, add, lambda s: F.when(s["on"], s["n"]).otherwise(1)))


def number_words(token: Column) -> Column:
    """Words of a number read aloud: a decimal's whole part, the point and each digit behind it."""
    whole, fraction = F.substring_index(token, ".", 1), F.regexp_extract(token, r"\.([0-9]+)$", 1)
    return digits_words(whole) + F.when(fraction != "", 1 + F.length(fraction)).otherwise(0)


def _unsigned_words(text: Column, table: Column | None) -> Column:
    """Words of the parts of a text; the units of numbers count as `table` says.

    Most parts are no numbers and count one, so only numbers are looked at, and of them only whole parts of three digits
    or more one by one."""
    ones = F.regexp_extract_all(F.replace(text, F.lit("’"), F.lit("'")), F.lit(NUMBERS), F.lit(1))  # for each part its number, else an empty string

    def beyond(numbers: Column) -> Column:
        units = F.regexp_extract_all(numbers, F.lit(UNIT), F.lit(0))
        named = F.size(units) if table is None else F.aggregate(units, F.lit(0.0), lambda n, x: n + F.coalesce(F.try_element_at(table, x), F.lit(1.0)))
        fractions = F.length(numbers) - F.length(F.regexp_replace(numbers, FRACTION, ""))
        wholes = F.regexp_extract_all(numbers, F.lit(LONG_WHOLE), F.lit(1))
        return named + fractions + F.aggregate(wholes, F.lit(0).cast("long"), lambda n, x: n + digits_words(x) - 1)

    return let(ones, lambda x: F.size(x) + let(F.array_join(x, " "), beyond)).cast("double")


def spoken_words(text: Column, table: Column | None = None) -> Column:
    """Words that reading a text aloud takes; 0 for null.

    A minus before a digit, a Greek letter and the symbols of SYMBOL_WORDS count by their names. Of the tokens, one in
    `table` (a map from tokens to words, say of acronyms) counts as it says; else its parts between hyphens count one by
    one: a number as it is read, a number with a unit of up to three letters as number and unit (the unit by the table if
    it is there, ordinals without), anything else one."""
    rest = F.regexp_replace(text, NO_SIGN, "")
    signs = F.regexp_count(text, F.lit(MINUS)) + F.regexp_count(rest, F.lit(GREEK_LETTER))
    for sign, k in SYMBOL_WORDS.items():
        signs = signs + k * (F.length(rest) - F.length(F.replace(rest, F.lit(sign), F.lit(""))))
    if table is None:
        return F.coalesce(signs + _unsigned_words(text, None), F.lit(0.0))
    table = F.coalesce(table.cast("map<string,double>"), F.create_map().cast("map<string,double>"))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    split = F.flatten(F.transform(tokens, lambda x: F.when(F.try_element_at(table, x).isNotNull(), F.array(x)).otherwise(F.regexp_extract_all(x, F.lit(PART), F.lit(0)))))
    parts = F.when(F.contains(F.array_join(F.map_keys(table), ""), F.lit("-")), split).otherwise(F.regexp_extract_all(text, F.lit(PART), F.lit(0)))

    def words(parts: Column) -> Column:
        in_table = lambda x: F.try_element_at(table, x).isNotNull() & ~x.rlike(NUMBER)
        listed = F.aggregate(parts, F.lit(0.0), lambda n, x: F.when(in_table(x), n + F.try_element_at(table, x)).otherwise(n))
        return listed + _unsigned_words(F.array_join(F.filter(parts, lambda x: ~in_table(x)), " "), table)

    return F.coalesce(signs + let(parts, words), F.lit(0.0))


def talk_seconds(words: Column, syllable_count: Column | int = 0, pause: Column | int = 0) -> Column:
    return words * 60.0 / WORDS_PER_MINUTE + syllable_count / SYLLABLES_PER_SECOND + pause


def slide_seconds(text: Column, pause: Column | int = 0, table: Column | None = None) -> Column:
    """Whole seconds of what is said on one slide, half to even; slides are rounded one by one, then added."""
    return F.rint(talk_seconds(spoken_words(text, table), F.coalesce(syllables(text), F.lit(0)), pause)).cast("long")


def clock(seconds: Column) -> Column:
    """m:ss of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def cell_number(text: Column) -> Column:
    """A cell as a number: sign, digits, an exponent or a suffix k M G B T or a word; null where there is none."""
    t = F.translate(text, "−", "-")
    digits = F.replace(F.regexp_extract(t, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    power = F.regexp_extract(t, r"[0-9](?:e|E|×10\^)(-?[0-9]+)", 1).try_cast("int")
    unit = F.lower(F.regexp_extract(t, r"[0-9] ?(thousand|million|billion|trillion)", 1))
    suffix = F.regexp_extract(t, r"[0-9] ?([kKMGBT])(?:[^A-Za-z]|$)", 1)
    scale = F.when(power.isNotNull(), F.pow(F.lit(10.0), power)).when(unit == "thousand", 1e3).when(unit == "million", 1e6).when(unit == "billion", 1e9).when(unit == "trillion", 1e12)
    scale = scale.when(F.lower(suffix) == "k", 1e3).when(suffix == "M", 1e6).when(suffix.isin("G", "B"), 1e9).when(suffix == "T", 1e12).otherwise(1.0)
    return digits * scale


def is_blank(text: Column) -> Column:
    """Blank cells say "not run"."""
    return F.coalesce(F.trim(text), F.lit("")).isin("", "-", "–", "—", "n/a", "N/A")


def jaccard(a: Column, b: Column) -> Column:
    united = F.size(F.array_union(a, b))
    return F.when(united > 0, F.size(F.array_intersect(a, b)) / united).otherwise(0.0)
