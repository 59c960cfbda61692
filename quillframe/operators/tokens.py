"""Unicode folding, C1 repair and the configurable tokenizer, as one nested Column expression each.

The tokenizer's stages are expand, normalize, shorten, non-word tokens, split and filter.
Options are read once, on the driver: a category left at ``keep`` adds nothing to the plan.
Only decomposition, entity names and backslash escapes leave SQL, and only if asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import scalars, udfs

#: General categories and the character that stands for each when unified (fixed values).
UNIFIED = {
    "Lu": "A", "Ll": "a", "Lt": "A", "Lm": "a", "Lo": "a", "Mn": "", "Mc": "", "Me": "", "Nd": "9", "Nl": "9", "No": "9",
    "Pd": "-", "Ps": "(", "Pe": ")", "Pi": "'", "Pf": "'", "Pc": "_", "Po": "*", "Sc": "$", "Sk": "^", "Sm": "=", "So": "#",
    "Zs": " ", "Zl": " ", "Zp": " ", "Cc": "", "Cf": "", "Co": "?", "Cn": "?",
}
COVERS = ("L", "M", "N", "P", "S", "Z", "C")
DISPOSITIONS = ("keep", "unify", "delete", "space", "strip", "value", "upper", "lower", "decompose")

#: Non-word tokens in order of application: (name, pattern, what it becomes when unified).
NON_WORD = (
    ("T_TIME", r"\b[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?(?: ?[ap]\.?m\.?)?(?: ?[ECMP][SD]T)?", "09:09"),
    ("T_DATE", r"\b[12][0-9]{3}[-/][0-3]?[0-9][-/][0-3]?[0-9]\b|\b[12][0-9]{3} ?(?:AD|BCE|BC|CE)\b", "2009-09-09"),
    ("T_FRACTION", r"\b(?:[0-9]+-)?[0-9]+/[0-9]+\b|[\x{00BC}-\x{00BE}\x{2150}-\x{215F}\x{2189}]", "9/9"),
    ("T_PERCENT", r"\b[0-9]+(?:\.[0-9]+)?[%\x{2030}\x{2031}\x{066A}\x{FE6A}\x{FF05}]", "99%"),
    ("T_CURRENCY", r"[$\x{00A3}\x{00A4}\x{0E3F}\x{17DB}\x{20A0}-\x{20CF}][0-9]+(?:\.[0-9]+)?[KMB]?", "$99"),
    ("T_EMOTICON", r"[-:;]+[(){}<>]", ":)"),
    ("T_HASHTAG", r"#[\p{L}]+", "#nine"),
    ("T_EMAIL", r"\b[0-9A-Za-z_]+@[0-9A-Za-z_]+(?:\.[0-9A-Za-z_]+)+", "user@example.com"),
    ("T_USER", r"(?:^|[ \t\n])@[.0-9A-Za-z_]+", " @nine"),
    ("T_URI", r"\b(?:shttp|https|http|ftp|mailto)://[-~?\[\]()&@+0-9A-Za-z_.:/$#]+[0-9A-Za-z_]", "http://www.example.com"),
)

#: Contracted forms that are spelt out as a whole (fixed values).
IRREGULAR = {
    "i'm": "I am", "y'all": "you all", "y'know": "you know", "it's": "it is", "'tis": "it is", "g'ahn": "go on", "let's": "let us",
    "let'r": "let her", "let'm": "let them", "c'mon": "come on", "coulda": "could have", "woulda": "would have", "shoulda": "should have",
    "musta": "must have", "oughta": "ought to", "hafta": "have to", "howda": "how do", "whaddya": "what do you", "willya": "will you",
    "gonna": "going to", "gotta": "got to", "wanna": "want to", "wanta": "want to", "cannot": "can not", "lookit": "look at",
    "lemme": "let me", "gimme": "give me", "ahm": "I am", "tain't": "it is not", "ain't": "is not", "can't": "can not", "won't": "will not",
    "'twas": "it was", "shan't": "shall not", "d'ye": "do you", "o'clock": "of the clock", "ma'am": "madam",
}
#: Endings that are spelt out behind any word, and those behind question words only (fixed values).
REGULAR = {"n't": "not", "'ve": "have", "'ll": "will", "'n": "than", "'re": "are", "'m": "am", "'d": "would"}
QUESTION_WORDS = ("who", "where", "what", "when", "why", "how")
QUESTION_REGULAR = {"'s": "is"}
#: Words before a period that ends no sentence (fixed values).
TITLES = ("Mr", "Dr", "Mrs", "Ms", "Messr", "Messrs", "Rev", "Fr", "St", "Pres", "Gen", "Cpl")


@dataclass
class TokenOptions:
    """What each stage does; everything is off or at ``keep`` unless set."""

    expand_backslash: bool = False
    expand_percent: bool = False
    expand_entities: bool = False
    ascii_only: bool = False
    #: General category, or a cover such as ``P``, to disposition. Named subcategories win over covers.
    categories: dict[str, str] = field(default_factory=dict)
    nbsp: str = "space"
    soft_hyphen: str = "delete"
    n_char: int = 0
    n_space: int = 0
    #: Non-word token name to ``unify``, ``delete`` or ``space``.
    non_word: dict[str, str] = field(default_factory=dict)
    split_hyphens: bool = False
    contractions: bool = False
    genitive: bool = False
    token_type: str = "words"
    min_length: int = 0
    max_length: int = 0
    drop_upper: bool = False
    drop_lower: bool = False
    drop_title: bool = False
    drop_mixed: bool = False
    drop_alnum: bool = False
    drop_punct: bool = False
    drop_space: bool = True

    def __post_init__(self):
        for name, value in [*self.categories.items(), ("nbsp", self.nbsp), ("soft_hyphen", self.soft_hyphen)]:
            if value not in DISPOSITIONS:
                raise ValueError(f"{name}: unknown disposition {value!r}")
        known = {n for n, _, _ in NON_WORD}
        if unknown := set(self.non_word) - known:
            raise ValueError(f"unknown token classes {sorted(unknown)}")
        if self.token_type not in ("words", "chars", "characters", "none"):
            raise ValueError(f"unknown token type {self.token_type!r}")

    def resolved(self) -> dict[str, str]:
        """Disposition of each category, covers spread to their subcategories."""
        out = {c: self.categories[c[0]] for c in UNIFIED if c[0] in self.categories}
        return out | {c: d for c, d in self.categories.items() if c in UNIFIED}


def dispose(x: Column, pattern: str, how: str, unified: str) -> Column:
    """One category's or character's disposition."""
    if how == "keep":
        return x
    if how == "unify":
        return F.regexp_replace(x, pattern, unified.replace("$", r"\$"))
    if how == "delete":
        return F.regexp_replace(x, pattern, "")
    if how == "space":
        return F.regexp_replace(x, pattern, " ")
    if how == "strip":
        return udfs.stripped_marks(x)
    if how == "decompose":
        return udfs.decomposed(x)
    if how == "upper":
        return F.upper(x)
    if how == "lower":
        return F.lower(x)
    return udfs.unified_values(x, pattern)


def expand(x: Column, o: TokenOptions) -> Column:
    x = udfs.unbackslashed(x) if o.expand_backslash else x
    x = F.coalesce(scalars.unescape_uri(x), x) if o.expand_percent else x
    return udfs.unescape_entities(x) if o.expand_entities else x


def normalize(x: Column, o: TokenOptions) -> Column:
    if o.ascii_only:
        return F.regexp_replace(x, r"[^\x00-\x7F]", "")
    x = dispose(x, " ", o.nbsp, " ")
    x = dispose(x, "­", o.soft_hyphen, "-")
    for category, how in o.resolved().items():
        x = dispose(x, rf"\p{{{category}}}", how, UNIFIED[category])
    return x


def shorten(x: Column, o: TokenOptions) -> Column:
    """Runs of n or more of one word character become n of it; runs of n or more blanks become one."""
    if o.n_char:
        x = F.regexp_replace(x, rf"([\p{{L}}\p{{M}}\p{{N}}_])\1{{{o.n_char},}}", "$1" * o.n_char)
    return F.regexp_replace(x, rf"\s{{{o.n_space},}}", " ") if o.n_space else x


def non_word_tokens(x: Column, o: TokenOptions) -> Column:
    for name, pattern, unified in NON_WORD:
        how = o.non_word.get(name, "keep")
        x = dispose(x, pattern, how, unified)
    return x


def non_word_counts(x: Column) -> dict[str, Column]:
    return {name: F.regexp_count(x, F.lit(pattern)) for name, pattern, _ in NON_WORD}


def expand_contractions(x: Column) -> Column:
    """Contracted forms spelt out. Texts are cut at white space once, and only words that may be contracted are looked at further."""
    whole = F.create_map(*[F.lit(v) for pair in IRREGULAR.items() for v in pair])
    endings = "|".join(sorted((*REGULAR, *QUESTION_REGULAR), key=len, reverse=True))
    ending_of = F.create_map(*[F.lit(v) for pair in (REGULAR | QUESTION_REGULAR).items() for v in pair])
    bare = r"^[^\p{L}\p{N}']*|[^\p{L}\p{N}]*$"

    def spelt(w: Column) -> Column:
        plain = F.lower(F.replace(F.regexp_replace(w, bare, ""), F.lit("’"), F.lit("'")))
        full = F.try_element_at(whole, plain)
        core = rf"(?i)^([^\p{{L}}\p{{N}}']*)[\p{{L}}\p{{N}}'’]+?([^\p{{L}}\p{{N}}]*)$"
        stem, ending = F.regexp_extract(plain, rf"^(.*[\p{{L}}])({endings})$", 1), F.regexp_extract(plain, rf"^(.*[\p{{L}}])({endings})$", 2)
        asked = ~ending.isin(*QUESTION_REGULAR) | stem.isin(*QUESTION_WORDS)
        cut = F.concat(F.regexp_replace(w, rf"(?i)(?<=[\p{{L}}])(?:{endings.replace(chr(39), "['’]")})([^\p{{L}}\p{{N}}]*)$", ""), F.lit(" "), F.try_element_at(ending_of, ending), F.regexp_extract(w, r"([^\p{L}\p{N}]*)$", 1))
        return F.when(full.isNotNull(), F.concat(F.regexp_extract(w, core, 1), full, F.regexp_extract(w, core, 2))).when((ending != "") & asked, cut).otherwise(w)

    plain_forms = "|".join(k for k in IRREGULAR if "'" not in k)
    likely = rf"['’]|(?i)^\W*(?:{plain_forms})\W*$"
    return F.array_join(F.transform(F.split(x, r"(?<=\s)(?=\S)"), lambda w: F.when(w.rlike(likely), F.concat(spelt(F.regexp_extract(w, r"^(\S*)", 1)), F.regexp_extract(w, r"(\s*)$", 1))).otherwise(w)), "")


def split_tokens(x: Column, o: TokenOptions) -> Column:
    if o.token_type == "none":
        return F.array(x)
    if o.token_type in ("chars", "characters"):
        return F.split(x, "")
    x = F.regexp_replace(x, r"--+", " -- ")
    x = F.regexp_replace(x, r"([./*\\#=?!])\1{2,}", " $1$1$1 ")
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}])-(?=[\p{L}\p{N}])", " - ") if o.split_hyphens else x
    x = expand_contractions(x) if o.contractions else x
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}])['’]s\b", " 's") if o.genitive else x
    # neither a title nor a single letter ends a sentence
    x = F.regexp_replace(x, rf"(?<=[\p{{Ll}}\p{{N}}])(?<!\b\p{{L}})(?<!\b(?:{'|'.join(TITLES)}))\.\s+(?=\p{{Lu}})", " . ")
    x = F.regexp_replace(x, r"(?<=^|\s)([\p{P}&&[^-_@#'’.]])(?=[\p{L}\p{N}])", "$1 ")
    x = F.regexp_replace(x, r"(?<=[\p{L}\p{N}\p{P}])([,;:!?)\]}\"”»]|\.(?=\s*$))(?=\s|$)", " $1")
    return F.split(x, r"\s+")


def filter_tokens(tokens: Column, o: TokenOptions) -> Column:
    """Title is one capital and no other; mixed has a capital past its first letter beside a small one; alnum has letters and digits."""

    def stays(t: Column) -> Column:
        ok = t != ""
        rules = (
            (o.min_length, F.length(t) >= o.min_length),
            (o.max_length, F.length(t) <= o.max_length),
            (o.drop_space, ~t.rlike(r"^\s+$")),
            (o.drop_upper, ~t.rlike(r"^\p{Lu}+$")),
            (o.drop_lower, ~t.rlike(r"^\p{Ll}+$")),
            (o.drop_title, ~t.rlike(r"^\p{Lu}\p{Ll}+$")),
            (o.drop_mixed, ~(t.rlike(r"^.+\p{Lu}") & t.rlike(r"\p{Ll}"))),
            (o.drop_alnum, ~(t.rlike(r"\p{L}") & t.rlike(r"\p{N}"))),
            (o.drop_punct, ~t.rlike(r"^\p{P}+$")),
        )
        for on, rule in rules:
            if on:
                ok = ok & rule
        return ok

    return F.filter(tokens, stays)


def tokenize(x: Column, options: TokenOptions | None = None) -> Column:
    """Text to its tokens, through all stages."""
    o = options or TokenOptions()
    for stage in (expand, normalize, shorten, non_word_tokens):
        x = stage(x, o)
    return filter_tokens(split_tokens(x, o), o)


def without_dictionary(tokens: DataFrame, column: str, dictionary: DataFrame, word: str) -> DataFrame:
    """Token rows that are not in the dictionary; the planner broadcasts it if it is small."""
    return tokens.join(dictionary.select(F.col(word).alias(column)).distinct(), column, "left_anti")


# --- folding and repair --------------------------------------------------------------

#: Letters that compatibility decomposition keeps whole (fixed values).
LETTER_PAIRS = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ĳ": "IJ", "ĳ": "ij", "ß": "ss", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l", "Þ": "Th", "þ": "th", "ı": "i"}


def simplify(
    x: Column, accents: str = "strip", ligatures: bool = True, dashes: bool = True, quotes: bool = True, spaces: bool = True, numbers: bool = False
) -> Column:
    """Folds text to plain letters. accents: keep, strip, decompose, compose, space or delete (the letter with its mark)."""
    if accents == "strip":
        x = udfs.stripped_marks(x)
    elif accents == "decompose":
        x = udfs.decomposed(x)
    elif accents == "compose":
        x = udfs.decomposed(x, "NFC")
    elif accents == "space":
        x = F.regexp_replace(udfs.decomposed(x), r"\p{M}", " ")
    elif accents == "delete":
        x = F.regexp_replace(udfs.decomposed(x), r".\p{M}+", "")
    if ligatures:
        for whole, parts in LETTER_PAIRS.items():
            x = F.replace(x, F.lit(whole), F.lit(parts))
    x = F.regexp_replace(x, r"\p{Pd}", "-") if dashes else x
    x = F.regexp_replace(F.regexp_replace(x, "[‘’‚‛‹›]", "'"), r"[\p{Pi}\p{Pf}„‟]", '"') if quotes else x
    x = F.regexp_replace(x, r"\p{Z}", " ") if spaces else x
    return udfs.unified_values(x, r"\p{No}") if numbers else x


#: What the bytes 0x80 to 0x9F mean in code page 1252; a blank has no meaning (fixed values).
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def cp1252_repair(x: Column, unknown: str = "?") -> Column:
    """C1 controls as the characters they were meant to be."""
    return F.translate(x, "".join(chr(0x80 + k) for k in range(32)), "".join(unknown if c == " " else c for c in CP1252))


def cp1252_entities(x: Column) -> Column:
    """C1 controls as character references to what they were meant to be."""
    for k, c in enumerate(CP1252):
        x = F.replace(x, F.lit(chr(0x80 + k)), F.lit("?" if c == " " else f"&#x{ord(c):X};"))
    return F.replace(x, F.lit(" "), F.lit("&nbsp;"))
