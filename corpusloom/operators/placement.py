"""Marks of a source text (paragraphs, character styles) placed in its translation by word alignment.

A mark stands before a source word. Put before a target word, it is crossed by each aligned pair whose words lie on different sides of it.
From one place to the next the number of crossings changes by the pairs of the word in between: one less for each
source word before the mark, one more for each after it. So the least number is the least running sum over pairs in the
order of their target words, one fold over an array in the JVM. Of places with equally few crossings the last is taken, the one right before
an aligned word.

Where punctuation beside the mark is aligned with punctuation, the mark goes beside that. Paragraphs are then moved away from
places where no line would begin: before closing marks, after opening ones, and within a few words of a sentence's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What doesn't begin a line, and what doesn't end one. Fixed values.
NOT_FIRST = ",;:.!?)]}”’"
NOT_LAST = "([{«‹“‘"
#: Words that a paragraph may be moved over to a sentence's border.
REACH = 3


def crossings(pairs: Column, at: Column, place: Column) -> Column:
    """Pairs (i, j) whose words lie on different sides of a mark before source word `at` and target word `place`."""
    return F.size(F.filter(pairs, lambda p: (p["i"] < at) != (p["j"] < place)))


def least_crossed(pairs: Column, at: Column, n_target: Column) -> Column:
    """The last of the places, from 0 to n_target, with the fewest crossings."""
    zero = F.lit(0)
    start = F.struct(zero.alias("sum"), F.lit(None).cast("int").alias("least"), zero.alias("place"), F.lit(-1).alias("j"))

    def step(s: Column, p: Column) -> Column:
        # Before the first pair of a target word, the sum is that of the place before the word.
        better = (p["j"] > s["j"]) & (s["least"].isNull() | (s["sum"] <= s["least"]))
        change = F.when(p["i"] < at, -1).otherwise(1)
        return F.struct((s["sum"] + change).alias("sum"), F.when(better, s["sum"]).otherwise(s["least"]).alias("least"), F.when(better, p["j"]).otherwise(s["place"]).alias("place"), p["j"].alias("j"))

    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct(p["j"].cast("int").alias("j"), p["i"].cast("int").alias("i"))))
    return F.aggregate(ordered, start, step, lambda s: F.when(s["least"].isNull() | (s["sum"] <= s["least"]), n_target).otherwise(s["place"]))


def _unlettered(word: Column) -> Column:
    return (F.length(word) > 0) & ~word.rlike(r"\p{L}")


def beside_punctuation(pairs: Column, at: Column, source: Column, target: Column) -> Column:
    """The place after target punctuation that is aligned with punctuation before the mark, else before that of punctuation after it; else null."""
    of = lambda i: F.transform(F.filter(pairs, lambda p: (p["i"] == i) & _unlettered(F.get(target, p["j"].cast("int")))), lambda p: p["j"].cast("int"))
    left = F.when(_unlettered(F.get(source, at - 1)), F.array_max(of(at - 1)) + 1)
    right = F.when(_unlettered(F.get(source, at)), F.array_min(of(at)))
    return F.coalesce(left, right)


def adjusted(place: Column, target: Column) -> Column:
    """A paragraph's place, moved to where a line may begin.

    It moves past marks that don't begin a line, back over marks that don't end one. If it then isn't after a mark, it moves over at most three words: back to a
    mark, if a capitalized word follows that and nothing but words lies between, else on past a mark, if a lower-case word begins
    here and nothing but words lies before that.
    """
    first, last = (lambda w, chars=chars: w.rlike("^[" + "".join("\\" + c for c in chars) + "]+$") for chars in (NOT_FIRST, NOT_LAST))
    n = F.size(target)
    run = lambda start, step, test: F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda s, _: F.when(test(s), s + step).otherwise(s))
    inside = lambda p: (p > 0) & (p < n)
    moved = run(place, 1, lambda p: inside(p) & F.coalesce(first(F.get(target, p)), F.lit(False)))
    moved = run(moved, -1, lambda p: inside(p) & F.coalesce(last(F.get(target, p - 1)), F.lit(False)))
    word = lambda i: F.coalesce(F.get(target, i).rlike(r"^[\p{L}\p{N}]"), F.lit(False))
    mark = lambda i: F.coalesce(F.get(target, i).rlike(r"^[^\p{L}\p{N}\s]+$"), F.lit(False))

    def bordered(at: Column) -> Column:
        all_words = lambda i, j: F.forall(F.sequence(i, j), word)
        upper = lambda k: F.coalesce(F.get(target, at - k).rlike(r"^\p{Lu}"), F.lit(False))
        lower = F.coalesce(F.get(target, at).rlike(r"^\p{Ll}"), F.lit(False))
        ends = lambda k: F.coalesce(first(F.get(target, at + k)), F.lit(False))
        near = range(1, REACH + 1)
        back = F.coalesce(*[F.when((at > k) & upper(k) & mark(at - k - 1) & all_words(at - k, at - 1), at - k) for k in near])
        on = F.coalesce(*[F.when(lower & ends(k) & all_words(at, at + k - 1), at + k + 1) for k in near])
        return F.when(inside(at) & ~mark(at - 1), F.coalesce(back, on, at)).otherwise(at)

    return _let(moved, bordered)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place_marks(segments: DataFrame, marks: str = "marks", source: str = "source_words", target: str = "target_words", pairs: str = "pairs") -> DataFrame:
    """segments with each mark (name, kind, at) having a place, the number of the target word that it stands before.

    kind is paragraph or style; at is from 0 to the number of source words. Marks are in the order of their places, of equal ones in
    their own. Without pairs, marks stand at the end. Null marks, words and pairs count as none; pairs beyond the words are left out.
    """
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(segments.schema[c].dataType))
    s, t = F.col("__s"), F.col("__t")
    rows = segments.withColumns({"__s": empty(source), "__t": empty(target)}).withColumn("__p", F.filter(empty(pairs), lambda p: (p["i"] >= 0) & (p["i"] < F.size("__s")) & (p["j"] >= 0) & (p["j"] < F.size("__t"))))

    def placed(m: Column) -> Column:
        place = F.coalesce(beside_punctuation(F.col("__p"), m["at"], s, t), least_crossed(F.col("__p"), m["at"], F.size(t)))
        return _let(place.cast("int"), lambda p: F.struct(F.when((m["kind"] == "paragraph") & (F.size("__p") > 0), adjusted(p, t)).otherwise(p).cast("int").alias("place"), m["at"].alias("at"), m["name"].alias("name"), m["kind"].alias("kind")))

    numbered = F.transform(F.transform(empty(marks), placed), lambda m, i: F.struct(m["place"].alias("place"), i.alias("n"), m.alias("m")))
    return rows.withColumn(marks, F.transform(F.array_sort(numbered), lambda x: x["m"])).drop("__s", "__t", "__p")


def marked_text(segments: DataFrame, name: str = "text", marks: str = "marks", target: str = "target_words") -> DataFrame:
    """segments with the target words as a text with place_marks' marks in it: a paragraph on a line of its own, a closing style after the word before it."""
    word = lambda i: F.coalesce(F.get(F.col(target), i), F.lit(""))
    said = lambda m: F.when(m["kind"] == "paragraph", F.concat(F.lit("\n\\"), m["name"], F.lit(" "))).when(m["name"].endswith("*"), F.concat(F.lit("\\"), m["name"])).otherwise(F.concat(F.lit(" \\"), m["name"], F.lit(" ")))
    here = lambda i: F.array_join(F.transform(F.filter(F.col(marks), lambda m: m["place"] == i), said), "")
    parts = F.transform(F.sequence(F.lit(0), F.size(target)), lambda i: F.concat(here(i), F.lit(" "), word(i)))
    text = F.regexp_replace(F.regexp_replace(F.array_join(parts, ""), " +", " "), r" ?\n ?", "\n")
    return segments.withColumn(name, F.trim(text))
