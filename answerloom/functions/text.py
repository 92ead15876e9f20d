"""Text functions: prompts, HTML cleaning, subtask extraction."""

import html

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from answerloom import fixed_values as fv
from answerloom.functions.basics import BLANKS, NUMBER, blank_if_null, strip, to_double


def decimal_comma(text: Column) -> Column:
    """'1,5' to 1.5; NULL where the text is no number."""
    return to_double(F.replace(text, F.lit(","), F.lit(".")))


def dirty_number(text: Column) -> Column:
    """Number that may be wrapped in quotes or led by an apostrophe.

    One pattern, read once per value: steps built on each other would be copied into the plan many times over.
    """
    pattern = rf"""\A{BLANKS}("?)'?{BLANKS}({NUMBER}){BLANKS}\1{BLANKS}\z"""
    return F.regexp_extract(text, pattern, 2).try_cast("double")


def prompt(question: Column, answer: Column, reference: Column | None = None) -> Column:
    """Model input; the reference answer is added where given and not blank."""
    parts = [
        F.concat(F.lit(fv.PROMPT_QUESTION), blank_if_null(question)),
        F.concat(F.lit(fv.PROMPT_ANSWER), blank_if_null(answer)),
    ]
    if reference is not None:
        parts.append(
            F.when(
                strip(reference) != "", F.concat(F.lit(fv.PROMPT_REFERENCE), reference)
            )
        )
    return F.concat_ws("\n", *parts)


def reference_option(options: Column) -> Column:
    """Answer of the first option marked correct, else of the first, else ''."""
    marked = F.filter(options, lambda o: F.coalesce(o["is_correct"], F.lit(False)))
    chosen = F.coalesce(F.try_element_at(marked, F.lit(1)), F.try_element_at(options, F.lit(1)))
    return blank_if_null(chosen["answer"])


def drop_styled_spans(text: Column) -> Column:
    for pattern in fv.SPAN_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return text


def unify_breaks(text: Column) -> Column:
    """Spans and marker out, paragraph breaks to line breaks, doubles halved once."""
    text = F.replace(drop_styled_spans(text), F.lit(fv.HTML_MARKER), F.lit(""))
    text = F.replace(text, F.lit(fv.PARAGRAPH_BREAK), F.lit(fv.LINE_BREAK))
    return F.replace(text, F.lit(fv.LINE_BREAK * 2), F.lit(fv.LINE_BREAK))


def clean_html(text: Column) -> Column:
    """`unify_breaks` without closing span tags; NULL gives ''."""
    return F.replace(unify_breaks(blank_if_null(text)), F.lit(fv.SPAN_END), F.lit(""))


@F.udf(returnType=StringType(), useArrow=False)
def decode_entities(text):
    """Decode HTML entities until nothing changes; NULL stays NULL.

    Texts go to Python a hundred at a time: whole pages in Arrow batches of 10,000 would all be in memory at once.
    """
    while text is not None and (decoded := html.unescape(text)) != text:
        text = decoded
    return text


def clean_remark(text: Column) -> Column:
    return F.replace(decode_entities(text), F.lit(fv.PARAGRAPH_BREAK), F.lit(fv.LINE_BREAK))


def _without_trailing_tags(text: Column) -> Column:
    text = F.regexp_replace(strip(text), "(?U)" + fv.TRAILING_PARAGRAPH, "")
    return F.regexp_replace(text, "(?U)" + fv.TRAILING_LINE_BREAK, "")


def _flatten_breaks(text: Column) -> Column:
    text = F.replace(text, F.lit(fv.SPAN_END), F.lit(""))
    text = F.regexp_replace(text, "(?U)" + fv.LINE_BREAK_PATTERN, " ")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def lettered(text: Column) -> Column:
    """A text in pieces, cut before every free-standing letter a. to h. in one scan.

    All pieces but the first begin with such a letter; joined they are the text. Subtasks are slices of
    them, so however many are wanted the text is read by one regular expression once.
    """
    # Letter and dot are compared first, as the boundary test is the costly one.
    return F.split(text, r"(?iU)(?=[a-h]\.(?<=\b[a-h]\.))")


def _after_mark(text: Column) -> Column:
    """Text after a letter, its dot and white space."""
    return F.regexp_replace(text, r"(?U)^\s+", "")


def find_loose(pieces: Column, letter: str) -> Column:
    """Text after 'x.' anywhere, up to the next lettered point a. to h., as it is."""
    mark = F.lit(f"{letter.lower()}.")

    def small(piece):
        return F.translate(piece, "ABCDEFGH", "abcdefgh")

    piece = F.get(F.filter(pieces, lambda p: F.contains(small(p), mark)), F.lit(0))
    found = _after_mark(F.substr(piece, F.instr(small(piece), f"{letter.lower()}.") + 2))
    return F.when(piece.isNotNull(), found).otherwise("")


def tidy_loose(found: Column) -> Column:
    return strip(_without_trailing_tags(blank_if_null(found)))


def subtask_loose(text: Column, letter: str) -> Column:
    """`find_loose` without the tags that trail it."""
    return tidy_loose(find_loose(lettered(text), letter))


def letter_marks(pieces: Column) -> Column:
    """The pieces with each one's letter, and again where a subtask may end before it: where no word goes on after the dot."""
    def letter(piece):
        return F.when(F.substring(piece, 2, 1) == ".", F.lower(F.substring(piece, 1, 1)))

    def may_end(piece, i):
        # A piece of a letter and a dot alone is followed by the next piece's letter.
        free = (F.length(piece) > 2) | (i + 1 == F.size(pieces))
        return F.when(free & ~F.substring(piece, 3, 1).rlike(r"(?U)\w"), letter(piece))

    ends = F.transform(pieces, may_end)
    return F.struct(pieces.alias("pieces"), F.transform(pieces, letter).alias("letters"), ends.alias("ends"))


def find_subtask(marks: Column, letter: str, section: str) -> Column:
    """Text after a free-standing 'x.' up to the letter that follows x, as it is, from `letter_marks`.

    Abbreviations such as 'e.g.' do not end a subtask. The last letter of a
    section, and any letter whose successor is missing, runs to the end.
    """
    letters = fv.QUIZ_LETTERS[section]
    letter = letter.lower()
    if letter not in letters:
        return F.lit("")
    place = letters.index(letter)
    pieces, n = marks["pieces"], F.size(marks["pieces"])
    first = F.array_position(marks["letters"], letter)
    length = n
    if place + 1 < len(letters):
        after = F.array_position(F.slice(marks["ends"], (first + 1).cast("int"), n), letters[place + 1])
        length = F.when(after > 0, after).otherwise(n)
    found = F.array_join(F.slice(pieces, first.cast("int"), length.cast("int")), "")
    return F.when(first > 0, _after_mark(F.substr(found, F.lit(3)))).otherwise("")


def tidy_subtask(found: Column) -> Column:
    return _flatten_breaks(_without_trailing_tags(blank_if_null(found)))


def subtask(text: Column, letter: str, section: str = "sentences") -> Column:
    """`find_subtask` as plain text: no tags, single blanks."""
    return tidy_subtask(find_subtask(letter_marks(lettered(text)), letter, section))


def strip_boilerplate(answer: Column) -> Column:
    """Answer without its 'True/False, because ...' opening and left-over tags."""
    answer = blank_if_null(answer)
    for pattern in fv.BOILERPLATE:
        answer = F.regexp_replace(answer, "(?iU)" + pattern, "")
    return _flatten_breaks(answer)
