"""Text functions as Column expressions (JVM-side unless the docstring says otherwise)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``str.isspace`` has it, as a Java character class.
WS = r"(?U)[\s\x1c-\x1f]"
NON_WS = r"(?U)[^\s\x1c-\x1f]"

#: The 32 ASCII punctuation marks, and the narrower set that ends a sentence.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SENTENCE_END = ".,!?;:"

#: Verbs that deny with "not" or "n't", and other words that deny, right after a short answer.
DENYING_VERBS = ("is", "was", "are", "were", "does", "do", "did", "has", "have", "had", "would", "could", "should")
DENYING_WORDS = ("not", "cannot", "can't", "will\\s+not", "won't")

#: The instruction of a generation prompt, and the version of all prompt texts.
SYSTEM_PROMPT = "You are a helpful assistant. Answer the question in one short, factual sentence."
PROMPT_VERSION = "v1"

_ASCII = r"^[\x00-\x7F]*\z"


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+\\z", "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Strip, and collapse white space runs to one space."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


# Row by row: Python holds a hundred texts at a time, where a pandas function is handed batches of
# ten thousand, whatever their bytes.


@F.udf(T.StringType(), useArrow=False)
def _nfc(text: str | None) -> str | None:
    """Unicode NFC; Spark has no builtin."""
    return None if text is None else unicodedata.normalize("NFC", text)


@F.udf(T.StringType(), useArrow=False)
def _nfkc_casefold(text: str | None) -> str | None:
    """NFKC and full case folding; Spark's ``lower`` isn't folding."""
    return None if text is None else unicodedata.normalize("NFKC", text).casefold()


@F.udf(T.StringType(), useArrow=False)
def _casefold(text: str | None) -> str | None:
    return None if text is None else text.casefold()


def beyond_ascii(text: Column, udf, ascii: Column) -> Column:
    """``udf(text)`` where the text isn't ASCII, else ``ascii``: Python is handed nulls for ASCII texts."""
    return F.coalesce(udf(F.when(~text.rlike(_ASCII), text)), ascii)


def clean(text: Column) -> Column:
    """Strip, collapse white space, NFC."""
    tidy = collapse(text)
    return beyond_ascii(tidy, _nfc, tidy)


def upper_by_letter(text: Column) -> Column:
    """Upper case letter for letter, as simple case mapping has it: a letter whose capitals would be
    several letters (ß, ligatures) takes its single capital or stays, so lengths never change."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).when(c == "ß", "ẞ").when(F.length(F.initcap(c)) == 1, F.initcap(c)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def normalized(text: Column) -> Column:
    """Key for leakage audits: NFKC, case folding, collapsed white space."""
    return collapse(beyond_ascii(text, _nfkc_casefold, F.lower(text)))


def normalized_answer(text: Column) -> Column:
    """Key for answer equality: case folding, collapsed white space; null counts as empty.
    Not for use inside lambdas of arrays, as it calls Python: normalise before collecting."""
    text = F.coalesce(text, F.lit(""))
    return collapse(beyond_ascii(text, _casefold, F.lower(text)))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NON_WS)


def char_length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Runs without white space; printable ASCII runs are cut to a letter first, which keeps their number."""
    return F.regexp_count(F.regexp_replace(text, "[!-~]+", "x"), F.lit(NON_WS + "+"))


@lru_cache
def _other_digits() -> str:
    """Character class of what ``str.isdigit`` takes beside decimal digits: superscripts, circled digits and the like."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()) + "]"


def formatting_features(text: Column) -> list[Column]:
    """The seventeen surface features of a text. Upper and lower case are shares of the
    letters, all other ratios are shares of the characters; denominators are at least one."""
    n = F.length(text)
    # most of a text is small ASCII letters and spaces: without them little is left in which the other kinds are counted
    letters, spaces = F.regexp_replace(text, "[a-z]+", ""), lambda t: F.replace(t, F.lit(" "), F.lit(""))
    bare = spaces(letters)
    small, space = n - F.length(letters), F.length(letters) - F.length(bare)
    without = lambda *signs: reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), signs, bare)
    sign = lambda *signs: F.length(bare) - F.length(without(*signs))
    count = lambda pattern: F.length(bare) - F.length(F.regexp_replace(bare, f"{pattern}+", ""))
    per = lambda c: c.cast("double") / F.greatest(n, F.lit(1))
    of_letters = lambda c: c.cast("double") / F.greatest(small + count(r"\p{L}"), F.lit(1))
    # rare kinds are counted only in texts that hold their general category
    rare = lambda sign, pattern: F.when(bare.rlike(sign), count(pattern)).otherwise(0)
    words = word_count(text)
    unique = F.size(F.array_distinct(F.split(bare, "")))
    unique = F.when(bare == "", 0).otherwise(unique) + sum((F.contains(text, F.lit(c)).cast("int") for c in " " + ascii_lowercase), F.lit(0))
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    values = {
        "char_count": n.cast("double"),
        "word_count": words.cast("double"),
        "avg_word_length": (n - space).cast("double") / F.greatest(words, F.lit(1)),
        "uppercase_ratio": of_letters(count(r"\p{Lu}")),
        "lowercase_ratio": of_letters(small + count(r"\p{Ll}") + rare(r"[\p{Lm}\xAA\xBA]", r"[\p{Lm}\p{Lo}&&\p{IsLowercase}]")),
        "digit_ratio": per(count(r"\p{Nd}") + rare(r"\p{No}", _other_digits())),
        "punctuation_ratio": per(count(r"\p{Punct}")),
        "whitespace_ratio": per(space + count(WS)),
        "unique_char_ratio": per(unique),
        "comma_ratio": per(sign(",")),
        "period_ratio": per(sign(".")),
        "question_mark_ratio": per(sign("?")),
        "exclamation_ratio": per(sign("!")),
        "parenthesis_ratio": per(sign("(", ")")),
        "non_ascii_ratio": per(count(r"[^\x00-\x7F]")),
        "starts_uppercase": flag(text.rlike(r"^\p{IsUppercase}")),
        "ends_punctuation": flag(F.substring(text, -1, 1).rlike(r"\p{Punct}\z")),
    }
    return [values[name].alias(name) for name in FEATURES]


FEATURES = (
    "char_count", "word_count", "avg_word_length", "uppercase_ratio", "lowercase_ratio", "digit_ratio", "punctuation_ratio", "whitespace_ratio", "unique_char_ratio",
    "comma_ratio", "period_ratio", "question_mark_ratio", "exclamation_ratio", "parenthesis_ratio", "non_ascii_ratio", "starts_uppercase", "ends_punctuation",
)


def ends_sentence(text: Column) -> Column:
    return F.right(text, F.lit(1)).isin(*SENTENCE_END)


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def _required(text: Column, what: str) -> Column:
    """The stripped text; a blank or null one is an error."""
    return F.when(is_blank(text), F.raise_error(F.lit(f"empty {what}")).cast("string")).otherwise(stripped(text))


def user_message(question: Column, knowledge: Column | None = None) -> Column:
    """Prompt body with the knowledge or, without such a column, of the question alone; blank parts are an error."""
    asked = F.concat(F.lit("Question: "), _required(question, "question"))
    return asked if knowledge is None else F.concat(F.lit("Knowledge: "), _required(knowledge, "knowledge"), F.lit("\n\n"), asked)


def generation_prompt(message: Column, system: str = SYSTEM_PROMPT, version: str = PROMPT_VERSION) -> Column:
    """Chat prompt with a system and a user turn, open for the answer. ``version`` is the
    one a run was configured with: another than that of the texts here is an error."""
    if version != PROMPT_VERSION:
        raise ValueError(f"prompt texts are version {PROMPT_VERSION!r}, the run says {version!r}")
    head = lambda role: f"<|start_header_id|>{role}<|end_header_id|>\n\n"
    return F.concat(F.lit(f"<|begin_of_text|>{head('system')}{system}<|eot_id|>{head('user')}"), message, F.lit(f"<|eot_id|>{head('assistant')}"))


def classifier_inputs(answer: Column, question: Column | None = None, knowledge: Column | None = None) -> tuple[Column, Column]:
    """Segment A, the question (if given) and always the answer, and segment B, the knowledge (null if not given)."""
    parts = [F.concat(F.lit(name), stripped(c)) for name, c in (("Question: ", question), ("Answer: ", answer)) if c is not None]
    second = F.lit(None).cast("string") if knowledge is None else F.concat(F.lit("Knowledge: "), stripped(knowledge))
    return F.concat_ws("\n", *parts), second


def anchored_short_answer(short: Column, long: Column, most_words: int = 3) -> Column:
    """True if ``short`` (at most three words) opens the longer text ``long`` as a term of its
    own and no denial follows. Case doesn't count; null counts as empty."""
    verbs = "|".join(DENYING_VERBS)
    denial = rf"(?U)^(?:(?:{verbs})(?:\s+not|n't)|{'|'.join(DENYING_WORDS)})\b"

    def opens(t):
        s, w = t["s"], t["w"]
        last, following = F.right(s, F.lit(1)), F.substring(w, F.length(s) + 1, F.lit(1))
        bounded = last.rlike(r"(?U)\w") != following.rlike(r"(?U)\w")  # a word ends, or starts, between the two
        rest = F.regexp_replace(F.substring(w, F.length(s) + 1, F.length(w)), "^[ \t:,\u2013\u2014-]+", "")
        fits = (s != "") & (word_count(s) <= most_words) & (word_count(w) > word_count(s))
        return fits & F.startswith(w, s) & bounded & ~rest.rlike(denial)

    tidy = lambda c: F.lower(stripped(F.coalesce(c, F.lit(""))))
    return bound(F.struct(tidy(short).alias("s"), tidy(long).alias("w")), opens)


def derived_seed(seed: int, key: Column, index: Column) -> Column:
    """Unsigned 32-bit seed from the first eight hex digits of sha256('seed:key:index')."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), index.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def preview(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def unfinished_thinking(text: Column, opens: str = "<think>", closes: str = "</think>") -> Column:
    """True where thinking was opened and never closed; null text has none."""
    shown = F.coalesce(text, F.lit(""))
    return shown.contains(opens) & ~shown.contains(closes)


def safe_name(name: Column) -> Column:
    """Model name fit for a file name."""
    return F.regexp_replace(name, "/", "__")


def until_stop(tokens: Column, stops: list[int]) -> tuple[Column, Column]:
    """Tokens up to and including the first stop token, and whether none was met."""
    found = F.filter(F.transform(tokens, lambda x, i: F.when(x.isin(*stops), i + 1)), lambda p: p.isNotNull())
    place = F.get(found, F.lit(0))
    return F.when(place.isNull(), tokens).otherwise(F.slice(tokens, F.lit(1), F.coalesce(place, F.lit(1)))), place.isNull()
