"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation stripped from both ends of a token.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Short forms of task names.
SHORT_FORMS = {
    "Machine_Translation": "MT", "Person_Pose_Estimation": "pose", "Language_Modelling": "LM", "Natural_Language_Inference": "NLI", "Object_Detection": "detect",
    "Image_Generation": "gan", "Sentiment_Analysis": "sent", "Speech_Recognition": "speech", "Visual_Question_Answering": "vqa", "Image_Classification": "img",
}
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "sgt.", "sen.", "col.", "brig.", "gen.", "maj.", "sr.", "lt.", "cmdr.", "u.s.", "mr.", "p.o.w.", "u.k.", "u.n.", "ft.", "dr.", "d.c.", "mt.", "st.", "snr.", "rep.", "ms.", "capt.", "sq.", "jr.", "ave.",
)
# Closing quotes and brackets that may stand behind a full stop.
CLOSERS = "\"')]}"
MARKER = "[CITE]"
# English words that carry no topic.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself "
    "it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't "
    "shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
)


def split_words(text: Column) -> Column:
    """Whitespace-separated words (Unicode white space), without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation at their ends, and without those that it empties.

    One match for each word, from its first character that is no punctuation to its last: nothing is built and then trimmed.
    """
    marks = "".join(f"\\{c}" for c in PUNCTUATION)
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)[^\s{marks}]++(?:[{marks}]++[^\s{marks}]++)*+"), 0)


def counted(words: Column) -> Column:
    """(term, tf) of each distinct word of an array, in order; null for null, none for an empty one. Sorted, then cut into runs."""

    def runs(w: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        run = lambda a: F.transform(a, lambda p, j: F.struct(F.get(w, p).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(w)) - p).cast("long").alias("tf")))
        return once(first, run)

    # An empty array has no runs, but sequence() would count down from 0 to -1.
    return once(F.sort_array(words), lambda w: F.when(F.size(w) > 0, runs(w)).when(w.isNotNull(), F.array().cast("array<struct<term:string,tf:bigint>>")))


def inverted(entries: Column) -> Column:
    """A map's values to its keys; its values must differ."""
    return F.map_from_arrays(F.map_values(entries), F.map_keys(entries))


def join_sections(sections: Column, field: str = "text") -> Column:
    return F.concat_ws(" ", F.transform(sections, lambda s: s[field]))


def title(words: Column, sentences: Column, sections: Column) -> Column:
    """The first sentence's words, joined; an error where a document has no sections."""
    first = F.get(sentences, F.lit(0))
    text = F.concat_ws(" ", F.slice(words, F.get(first, F.lit(0)) + 1, F.get(first, F.lit(1)) - F.get(first, F.lit(0))))
    return F.when(F.size(sections) > 0, text).otherwise(F.raise_error(F.lit("a document without sections has no title")).cast("string"))


def abbreviate(name: Column, short: Mapping[str, str] = SHORT_FORMS) -> Column:
    """A short form if there is one, else the initials of the parts between underscores; 3D stays whole."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    initials = F.array_join(F.transform(parts, lambda p: F.when(p == "3D", p).otherwise(F.substring(p, 1, 1))), "")
    known = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), initials)


def splice(text: Column, start: Column, end: Column) -> Column:
    """text with its code points from start up to end (from 0) replaced by the citation marker."""
    return F.concat(F.substr(text, F.lit(1), start), F.lit(MARKER), F.substr(text, end + 1))


def sentences(text: Column) -> Column:
    """Sentences by rule.

    Blank lines always part them, and a single newline is a blank. A blank after . ? or ! parts them too, unless an
    abbreviation or an ellipsis stands before it, or a token with -- on either side of it.
    """
    return _sentences(F.split(_held(text), r"\n{2,}|(?<=[.!?])\s+"))


def _held(text: Column) -> Column:
    """text with single newlines as blanks, and U+0001 for each blank at which the rules of sentences() allow no end.

    Most texts lack what a rule is about, so they are searched for it before the rule's expression runs over them. Expressions
    that look at blanks ask first whether there is one, and only then what stands before it.
    """
    held = F.when(text.contains("\n"), F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")).otherwise(text)
    # Matches start at the start of a run and don't go back inside it, so that a long run costs no more than its length.
    held = F.when(text.contains("--"), F.regexp_replace(held, r"(?=[^\S\n])(?<![^\S\n])[^\S\n]++(?=\S*--)", "\u0001")).otherwise(held)
    dashes = F.regexp_replace(held, F.lit(r"((?<!\S)(?>\S*--\S*+)|\.\.\.)[^\S\n]+"), F.lit("$1\u0001"))
    held = F.when(text.contains("--") | text.contains("..."), dashes).otherwise(held)
    words = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return F.regexp_replace(held, rf"(?i)(?=[^\S\n])(?<=\.)(?<=(?<![\p{{L}}\p{{N}}.])(?:{words}))[^\S\n]++", "\u0001")


def _sentences(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.btrim(F.replace(s, F.lit("\u0001"), F.lit(" ")))), lambda s: s != "")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, also where then uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def base(word: Column) -> Column:
    """A word in lower case without punctuation at its ends; u.s. becomes u.s"""
    return F.btrim(F.lower(word), F.lit(PUNCTUATION))


def dotted(word: Column) -> Column:
    """Has the word one full stop at its end, or before other punctuation at its end?"""
    bare = F.rtrim(word, F.lit(PUNCTUATION.translate({ord(c): None for c in ".?!"})))
    return bare.endswith(".") & ~bare.endswith("..")


def stops(word: Column) -> Column:
    """Does the word, closing quotes and brackets aside, end in ? or ! or one full stop?"""
    bare = F.rtrim(word, F.lit(CLOSERS))
    return bare.endswith("?") | bare.endswith("!") | (bare.endswith(".") & ~bare.endswith(".."))


def pieces(text: Column) -> Column:
    """The text parted before every white space behind . ? or ! at which the rules of sentences() allow an end."""
    return F.split(_held(text), r"(?=\s)(?<=[.!?])")


# ASCII white space and the mark of _held(), as a class of regular expressions.
_BLANKS = r"\t\n\x0B\f\r\x01 "


def last_word(piece: Column) -> Column:
    """What stands behind the last blank: the greedy run goes to the end and back to that blank, no further."""
    return F.regexp_replace(piece, rf"(?s)\A.*[{_BLANKS}]", "")


def first_word(piece: Column) -> Column:
    return F.regexp_extract(piece, rf"\A[{_BLANKS}]*+([^{_BLANKS}]*+)", 1)


def learned_sentences(text: Column, abbreviations: Column, starters: Column) -> Column:
    """sentences() that also go on behind a learned abbreviation, unless a capitalised learned starter or a blank line follows.

    abbreviations, starters: arrays of base() forms; null counts as empty, and with two empty ones the result is that of sentences().
    """
    none = F.array().cast("array<string>")
    known, begins = F.coalesce(abbreviations, none), F.coalesce(starters, none)

    def marked(parts: Column, piece: Column, i: Column) -> Column:
        last, first = last_word(F.get(parts, i - 1)), first_word(piece)
        starts = F.array_contains(begins, base(first)) & F.ltrim(first, F.lit(PUNCTUATION)).rlike(r"^\p{Lu}")
        glued = dotted(last) & F.array_contains(known, base(last)) & ~piece.rlike(r"^\s*\n") & ~starts
        return F.when((i == 0) | glued, piece).otherwise(F.concat(F.lit("\u0003"), F.ltrim(piece, F.lit(" \t\n\x0b\f\r"))))

    joined = once(pieces(text), lambda parts: F.array_join(F.transform(parts, lambda piece, i: marked(parts, piece, i)), ""))
    return _sentences(F.split(joined, "\n{2,}|\u0003"))


def window(items: Column, at: Column, k: int) -> Column:
    """Items from at - k to at + k (positions from 0), cut at the ends."""
    start = F.greatest(at - k, F.lit(0))
    return F.slice(items, start + 1, F.least(at + 1 + k, F.size(items)) - start)
