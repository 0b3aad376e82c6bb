"""Normalisation of answers and tokens, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from string import ascii_lowercase, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols, words and contractions of the consensus metric's answer normalisation.
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't",
    "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've",
    "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't",
    "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've",
    "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've",
    "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've", "someonell": "someone'll",
    "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've", "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's",
    "thered": "there'd", "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've",
    "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's",
    "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're",
    "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll",
    "y'allll": "y'all'll", "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}
#: Answers that say nothing.
STOP_ANSWERS = ["unknown", "unanswerable", "cannot tell", "cannot determine", "not sure", "not applicable", "n/a", "none", "no answer", "answering does not require reading text in the image"]
#: Names of attack sets scored by normalised exact match.
EXACT_MATCH_TAGS = ["obj_attack_read", "read_typo_obj_attack", "attack_read"]

SPACES = r"\s+"


def trimmed(x: Column) -> Column:
    """Without white space at either end (``trim`` alone takes spaces only)."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def collapsed(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.regexp_replace(trimmed(x), SPACES, " ")


def choice_norm(x: Column) -> Column:
    """Lower case letters a-z, digits and single spaces only; null: empty."""
    return F.regexp_replace(collapsed(F.lower(F.coalesce(x, F.lit("")))), "[^a-z0-9 ]+", "")


def short_norm(x: Column) -> Column:
    """Lower case, without symbols other than ``_ : . / -``; one space for white space, also at the end where symbols went."""
    return F.regexp_replace(F.regexp_replace(trimmed(F.lower(x)), r"[^\p{L}\p{N}_\s:./-]", ""), SPACES, " ")


def plain_norm(x: Column) -> Column:
    """Lower case with single spaces."""
    return collapsed(F.lower(x))


def consensus_words(x: Column) -> Column:
    """First step of the consensus normalisation."""
    y = F.replace(F.translate(F.lower(x), ",?", ""), F.lit("'s"), F.lit(" 's"))
    return trimmed(F.translate(y, "\n\t", "  "))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def consensus_punctuation(x: Column) -> Column:
    """A symbol next to a space in ``x`` goes, any other becomes a space; then periods go unless a digit follows.

    Whether a symbol goes is read from ``x`` as it was; commas between digits make all symbols go. So one pass over the text suffices. All such periods
    go, where the metric's own code stops after 32.
    """

    def replaced(x: Column) -> Column:
        beside = lambda p: F.contains(x, F.lit(p + " ")) | F.contains(x, F.lit(" " + p))
        spaced = F.when(x.rlike(r"\d,+\d"), "").otherwise(F.concat(*[F.when(beside(p), "").otherwise(p) for p in PUNCTUATION]))
        # What has no counterpart goes: symbols that become spaces come first, then all, of which those are known already.
        return let(spaced, lambda m: F.call_function("translate", x, F.concat(m, F.lit("".join(PUNCTUATION))), F.repeat(F.lit(" "), F.length(m))))

    return F.regexp_replace(let(x, replaced), r"\.(?!\d)", "")


#: What takes the place of a word: digits, contractions, and nothing for articles.
_WORDS = NUMBER_WORDS | CONTRACTIONS | dict.fromkeys(ARTICLES, "")


def consensus_tokens(x: Column) -> Column:
    """Number words as digits, no articles, contractions with their apostrophes, joined by one space."""
    table = F.create_map(*[F.lit(v) for pair in _WORDS.items() for v in pair])
    words = F.split(F.lower(x), SPACES)
    # A set of literals is a hash look-up, a map's keys are gone through one by one: few words need that.
    words = F.transform(words, lambda w: F.when(w.isin(list(_WORDS)), F.try_element_at(table, w)).otherwise(w))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def consensus_norm(x: Column) -> Column:
    """The whole normalisation of the consensus metric."""
    return consensus_tokens(consensus_punctuation(consensus_words(x)))


def uses_exact_match(eval_metric: Column, *names: Column) -> Column:
    """Whether a sample is scored by normalised exact match: by its metric's name, or a tag in any of its names."""
    text = F.lower(F.concat_ws("\n", *names))
    return F.coalesce(F.lower(eval_metric).isin("normalized_em", "nem"), F.lit(False)) | text.rlike("|".join(EXACT_MATCH_TAGS))


@lru_cache(maxsize=1)
def compatibility_tables() -> tuple[str, str, str, str]:
    """Of Unicode's compatibility form, by the tables of Python's ``unicodedata``: a character class of what changes alone, into one character each, the characters and what they become, and a class of all else that can change.

    The latter are characters that become several or none alike, combine with others, or become such.
    """
    import sys
    from unicodedata import combining, decomposition, normalize

    points = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    pairs = [d.split() for d in map(decomposition, points) if d and not d.startswith("<")]
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2} | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    second |= {c for c in points if combining(c)}
    plain, other = {}, []
    for c in points:
        form = normalize("NFKC", c)
        if not second.isdisjoint(form) or c in second or (form != c and len(form) != 1):
            other.append(c)
        elif form != c:
            plain[c] = form
    return _class(list(plain)), "".join(plain), "".join(plain.values()), _class(other)


def _class(chars: list[str]) -> str:
    """A character class of a sorted list, as ranges."""
    out: list[list[int]] = []
    for i in map(ord, chars):
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def beyond_ascii(x: Column) -> Column:
    """The characters of a text that ASCII lacks."""
    return F.when(F.octet_length(x) == F.length(x), "").otherwise(F.regexp_replace(x, r"[\x00-\x7f]+", ""))


def nfkc(x: Column) -> Column:
    """Unicode's compatibility form, which Spark lacks.

    Texts in which characters change one by one, as wide letters and digits do, are translated by a built-in expression, and most others stay as they are. Only texts with characters that become several
    or combine go to ICU, which comes with Spark. None goes to Python: rows of which Python gets next to nothing would all wait for it at once, with all that they carry.
    """
    alone, before, after, other = compatibility_tables()
    # Large classes are slow to test, so only the characters beyond ASCII are, and those below U+0250 that never change, which is most, are told first.
    rest = beyond_ascii(x)
    odd = rest.rlike(r"[^\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{180}-\x{1c3}\x{1cd}-\x{1f0}\x{1f4}-\x{24f}]")
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    return F.when(odd & rest.rlike(other), composed).when(odd & rest.rlike(alone), F.translate(x, before, after)).otherwise(x)


def lines_of(words: Column) -> Column:
    """An array's words as one text of lines, null as an empty one. A line feed in a word counts as a space."""
    spaced = F.transform(words, lambda w: F.replace(w, F.lit("\n"), F.lit(" ")))
    return let(F.array_join(words, "\n", ""), lambda x: F.when(F.regexp_count(x, F.lit("\n")) < F.size(words), x).otherwise(F.array_join(spaced, "\n", "")))


def nfkc_words(words: Column) -> Column:
    """The compatibility forms of an array's words, null for null: one text of lines goes the way of ``nfkc``. A line feed in a word counts as a space."""
    lines = F.split(nfkc(lines_of(words)), "\n")
    return F.zip_with(words, F.slice(lines, 1, F.size(words)), lambda w, form: F.when(w.isNotNull(), form))


def robust_lines(x: Column) -> Column:
    """``robust_norm`` of each line of a text of compatibility forms."""
    # Classes of properties are slow, so texts whose characters beyond ASCII are small letters of Western Europe go by a class of single characters, for which Java keeps bits.
    western = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    plain = lambda y: ~beyond_ascii(y).rlike(f"[^{western}]")
    return let(F.lower(x), lambda y: F.when(plain(y), F.regexp_replace(y, f"[^{ascii_lowercase}{digits}{western}_\n]+", "")).otherwise(F.regexp_replace(y, r"[^\p{L}\p{N}_\n]+", "")))


def robust_norm(x: Column, compatibility: bool = True) -> Column:
    """Lower case letters, digits and underscores alone, without spaces."""
    return F.regexp_replace(F.lower(nfkc(x) if compatibility else x), r"[^\p{L}\p{N}_]+", "")


def numbers_in(x: Column) -> Column:
    """Numbers with their decimal marks; commas go."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(\d+(?:[.,]\d+)*)"), 1), lambda n: F.replace(n, F.lit(","), F.lit("")))


def keywords(x: Column, least: int = 3) -> Column:
    """Words between white space and punctuation, in lower case, of at least ``least`` characters."""
    words = F.transform(F.split(F.lower(x), r"[\s/:\-_,.;!?()\[\]{}]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]+", ""))
    return F.filter(words, lambda w: F.length(w) >= least)


def token_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 0 where either is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest substring that both have (N15); 0 for null.

    A window slides over the shorter text and grows by a letter wherever the other text has it with one more, so there are at most as many steps as letters of the shorter text and of the result.
    """

    def found(own: Column, other: Column) -> Column:
        n = F.length(own)

        def step(s: Column, _: Column) -> Column:
            grows = (s["at"] + s["best"] <= n) & F.contains(other, F.substring(own, s["at"], s["best"] + 1))
            return F.when(grows, F.struct(s["at"].alias("at"), (s["best"] + 1).alias("best"))).otherwise(F.struct((s["at"] + 1).alias("at"), s["best"].alias("best")))

        return F.aggregate(F.sequence(F.lit(1), 2 * n), F.struct(F.lit(1).alias("at"), F.lit(0).alias("best")), step, lambda s: s["best"])

    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(some, F.when(F.length(a) <= F.length(b), found(a, b)).otherwise(found(b, a))).otherwise(0)


def seed_of(*parts: Column) -> Column:
    """A 31-bit seed from the md5 of the parts joined by two underscores: the low bits of the first 16 digits."""
    return F.conv(F.substring(F.md5(F.concat_ws("__", *parts)), 9, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by hyphens."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def without_image_extension(x: Column) -> Column:
    """A file name without .jpg, .jpeg or .png."""
    return F.regexp_replace(x, r"\.(jpg|jpeg|png)", "")
