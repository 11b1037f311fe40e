"""Text normalizers and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that label each result on a report.
RESULT_LABELS = {
    "glucose": ["glucose", "glu"], "hemoglobin": ["hemoglobin", "haemoglobin", "hgb", "hb"], "hematocrit": ["hematocrit", "haematocrit", "hct"],
    "white_blood_cell_count": ["white", "wbc", "leukocyte", "leukocytes", "leucocytes"], "platelet_count": ["platelet", "platelets", "plt"],
}
UNKNOWN_SEX = ["u", "unknown", "unk", "other", "o", "x", "not specified", "not stated", "undisclosed", "n/a", "na"]
LABEL_WINDOW = 12
LONG_VALUE = 200
#: Spelled out, which Java looks up in a table; ranges are compared one after another.
WORD_CHARS = "0123456789abcdefghijklmnopqrstuvwxyz"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")


def name_misread(name: Column) -> Column:
    """A digit in a name, or a word that starts in lower case beside one that starts in upper case."""
    words = F.split(F.coalesce(name, F.lit("")), r"[\s,]+")
    lower, upper = F.exists(words, lambda w: w.rlike(r"^\p{Ll}")), F.exists(words, lambda w: w.rlike(r"^\p{Lu}"))
    return F.coalesce(name, F.lit("")).rlike(r"\d") | (lower & upper)


def normalize_sex(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin("m", "male", "man"), "M").when(s.isin("f", "female", "woman"), "F")


def unknown_sex(c: Column) -> Column:
    """Spellings that say the sex isn't known; they don't hold a document."""
    return F.lower(normalize_text(c)).isin(UNKNOWN_SEX)


def normalize_flag(c: Column) -> Column:
    f = F.upper(F.trim(c))
    return F.when(f.isin("H", "HH", "HIGH"), "H").when(f.isin("L", "LL", "LOW"), "L")


def csv_cell(c: Column) -> Column:
    """A leading quote keeps spreadsheets from taking a cell for a formula."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    risky = text.rlike(r"^[=+@\t\r]") | (text.startswith("-") & text.try_cast("double").isNull())
    return F.when(risky, F.concat(F.lit("'"), text)).otherwise(text)


def basename(path: Column) -> Column:
    """The file's own name, whichever way its folders are parted."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def uuid_or_null(c: Column) -> Column:
    return F.when(c.rlike(UUID), c)


def page_words(page: Column) -> Column:
    """The words of a page without case and punctuation, with spaces between them: one pass of one pattern."""
    spaced = F.translate(F.lower(F.coalesce(page, F.lit(""))), "\t\n\x0b\f\r", "     ")
    return F.regexp_replace(spaced, f"[^{WORD_CHARS} ]+", "")


def page_tokens(page: Column) -> Column:
    """The same words as an array."""
    return F.filter(F.split(page_words(page), " "), lambda t: t != "")


def stands_among(value: Column, words: Column, field: Column) -> Column:
    """Whether a value stands among ``page_words`` as whole words, results within LABEL_WINDOW words after their label.

    A value may span words; digits may be glued to a unit. One pattern a row looks for all of this, so the cost is one pass of
    the words. ``words`` should be a column of its own, not the expression that makes it.
    """
    v = squash(value)
    behind = F.lit("(?<![^ ])")
    for name, labels in RESULT_LABELS.items():
        behind = F.when(field == name, f"(?<![^ ])(?:{'|'.join(labels)})(?: ++[^ ]++){{0,{LABEL_WINDOW - 1}}} ++").otherwise(behind)
    # Every character may be followed by the end of a word; after all digits a unit may go on.
    wanted = F.concat(behind, F.lit("(?:"), F.array_join(F.split(v, ""), " *+"), F.lit("(?![^ ])"), F.when(v.rlike("^[0-9]+$"), F.concat(F.lit("|"), v, F.lit("[a-z]"))).otherwise(""), F.lit(")"))
    # A pattern's depth grows with the value, so a very long one is compared word by word.
    found = F.when(F.length(v) > LONG_VALUE, _long_stands(v, F.filter(F.split(words, " "), lambda t: t != ""), field)).otherwise(F.rlike(words, wanted))
    return F.when(F.coalesce(v, F.lit("")) == "", True).otherwise(F.coalesce(found, F.lit(False)))


def _long_stands(v: Column, tokens: Column, field: Column) -> Column:
    """The same for values of more than LONG_VALUE characters: the tokens from a place on, joined, begin with the value and one ends there."""
    labels = F.array().cast("array<string>")
    for name, words in RESULT_LABELS.items():
        labels = F.when(field == name, F.array(*[F.lit(w) for w in words])).otherwise(labels)

    def at(i: Column) -> Column:
        token = F.get(tokens, i - 1)
        spans = F.exists(F.sequence(F.lit(1), F.length(v)), lambda n: F.array_join(F.slice(tokens, i, n), "") == v)
        glued = v.rlike("^[0-9]+$") & token.startswith(v) & F.substr(token, F.length(v) + 1).rlike("^[a-z]")
        before = F.slice(tokens, F.greatest(F.lit(1), i - LABEL_WINDOW), F.least(i - 1, F.lit(LABEL_WINDOW)))
        return (spans | glued) & ((F.size(labels) == 0) | F.arrays_overlap(before, labels))

    likely = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: v.startswith(F.get(tokens, i - 1)) | F.get(tokens, i - 1).startswith(v))
    return F.exists(likely, at)


def stands_in(value: Column, tokens: Column, field: Column) -> Column:
    """``stands_among`` for the words as an array."""
    return stands_among(value, F.array_join(tokens, " "), field)


def printed_on_page(value: Column, page: Column, field: Column) -> Column:
    """``stands_among`` for a page's text."""
    return stands_among(value, page_words(page), field)


def password_ok(password: Column, username: Column) -> Column:
    classes = sum(password.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return (F.length(password) >= 12) & (F.trim(password) == password) & ~F.contains(F.lower(password), F.lower(username)) & (classes >= 3)
