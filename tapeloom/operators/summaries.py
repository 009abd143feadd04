"""Texts for and from a summariser: chunk plans, extracts, reports, tolerant reading of a model's answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.operators import folds
from tapeloom.session import checkpoint

ANSWER = "summary string, tldr string, key_takeaways array<string>, who_should_watch string, who_can_skip string, action_steps array<string>, best_quotes array<string>, chapters array<string>"
# The rules between a report's sections; its titles and those of chapters stand where they are used.
RULE, LINE = "=" * 60, "-" * 40


def chunk_target(target: Column, chunks: Column, chunk_words: Column, words: Column) -> Column:
    """Words that a chunk's summary gets of the whole's target, by its size; 50 at least, no more than the chunk has."""
    share = F.greatest(F.lit(50), F.floor(target / chunks).cast("int"))
    return F.least(F.greatest(F.lit(50), (share * (chunk_words / (words / chunks))).cast("int")), chunk_words)


def first_words(words: Column, n: Column) -> Column:
    """The shortening that stands in where no model answers: the first n words."""
    return F.slice(words, F.lit(1), n.cast("int"))


def summarised(
    texts: DataFrame, key: str, target: int, chunk_words: int = 800, most_rounds: int = 3, over: float = 1.15, last: float = 1.2, shorten: Callable[[Column, Column], Column] = first_words
) -> DataFrame:
    """(key, rounds, words, text) of texts (key, text): each brought down to about `target` words, level by level.

    A cleaned text of up to `over` times the target stays as it is. A longer one is cut into chunks of sentences, up to
    `chunk_words` words each; every chunk is shortened to its share, and the joined text goes through another round while
    it is still too long. A text of one chunk is shortened to the target. After `most_rounds`, a text of up to `last`
    times a chunk is shortened to the target, a longer one stays. Only unfinished texts enter a round, each within its
    row: `shorten` takes a column of words and the number that may stay. A null text counts as empty; repeated keys stay.
    """
    limit, kept = target * over, [key, "rounds", "w"]
    waiting = texts.select(key, F.lit(0).alias("rounds"), T.words(T.cleaned(F.coalesce("text", F.lit("")))).alias("w"))
    out = None
    for step in range(most_rounds + 1):
        n = F.size("w")
        if step == most_rounds:
            now = waiting.select(key, "rounds", F.when((n > limit) & (n <= chunk_words * last), shorten(F.col("w"), F.lit(target))).otherwise(F.col("w")).alias("w"), F.lit(True).alias("done"))
        else:
            sizes = F.transform(T.sentences(F.array_join("w", " ")), T.word_count)
            chunks = F.when(n > limit, F.transform(folds.packed(sizes, chunk_words), lambda b: b["size"].cast("int"))).alias("chunks")
            begins = F.aggregate("chunks", F.array(F.lit(1)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)).alias("begins")
            part = lambda x, i: shorten(F.slice("w", F.get("begins", i), x), chunk_target(F.lit(target), F.size("chunks"), x, n))
            shorter = F.when(F.col("chunks").isNull(), F.col("w")).when(F.size("chunks") == 1, shorten(F.col("w"), F.lit(target))).otherwise(F.flatten(F.transform("chunks", part)))
            cut = waiting.select(*kept, chunks).select(*kept, "chunks", begins).select(key, F.when(F.col("chunks").isNull(), F.col("rounds")).otherwise(F.lit(step + 1)).alias("rounds"), shorter.alias("w"), (F.coalesce(F.size("chunks"), F.lit(1)) == 1).alias("one"))
            now = cut.select(*kept, (F.col("one") | (n <= limit)).alias("done"))
        now = checkpoint(now)
        done, waiting = now.where("done"), now.where("not done")
        out = done if out is None else out.unionByName(done)
        if waiting.isEmpty():
            break
    return out.select(key, F.col("rounds").cast("long").alias("rounds"), F.size("w").cast("long").alias("words"), F.array_join("w", " ").alias("text"))


def report(summary: Column, tldr: Column, takeaways: Column, chapters: Column, quotes: Column, watch: Column, skip: Column, steps: Column) -> Column:
    """A plain-text report with a section for each part that isn't empty.

    takeaways and steps are arrays of strings, chapters of (title, text), quotes of (text, speaker).
    """

    def numbered(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda t, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), t)), "\n")

    def section(title: str, body: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"{LINE}\n{title}\n{LINE}\n"), body, F.lit("\n\n")))

    some = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    full = lambda s: F.coalesce(s != "", F.lit(False))
    told = F.transform(chapters, lambda c, i: F.concat(F.lit("\n  "), (i + 1).cast("string"), F.lit(". "), F.coalesce(c["title"], F.concat(F.lit("Chapter "), (i + 1).cast("string"))), F.lit("\n     "), F.coalesce(c["text"], F.lit(""))))
    cited = F.transform(quotes, lambda q: F.concat(F.lit('  "'), F.coalesce(q["text"], F.lit("")), F.lit('"'), F.when(F.coalesce(q["speaker"], F.lit("")) != "", F.concat(F.lit(" — "), q["speaker"])).otherwise("")))
    who = F.concat_ws("\n", F.when(full(watch), F.concat(F.lit("WHO SHOULD WATCH: "), watch)), F.when(full(skip), F.concat(F.lit("WHO CAN SKIP: "), skip)))
    parts = [
        F.when(full(tldr), F.concat(F.lit("TL;DR: "), tldr, F.lit("\n\n"))),
        F.concat(F.lit(f"{RULE}\nSUMMARY\n{RULE}\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n")),
        section("KEY TAKEAWAYS", numbered(takeaways), some(takeaways)),
        section("CHAPTERS", F.array_join(told, "\n"), some(chapters)),
        section("BEST QUOTES", F.array_join(cited, "\n"), some(quotes)),
        F.when(full(watch) | full(skip), F.concat(F.lit(f"{LINE}\n"), who, F.lit("\n\n"))),
        section("ACTION STEPS", numbered(steps), some(steps)),
        F.lit(f"{RULE}\nGenerated by Transcript Summarizer\n{RULE}"),
    ]
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def tolerant(answer: Column) -> Column:
    """A model's JSON answer as a struct: as it is, else in a fenced block, else from the first brace to the last one.

    What can't be read is a summary as it stands. Missing fields are '' or empty lists; best_quotes are (text, speaker),
    whether given as strings or objects; chapters are (title, text), and those that aren't objects are dropped.
    """
    read = lambda s: F.when(F.trim(s).startswith("{"), F.from_json(s, ANSWER, {"mode": "PERMISSIVE"}))
    ok = lambda s: F.try_parse_json(s).isNotNull()
    fenced = F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), F.lit(""))
    raw = F.struct(F.trim(answer).alias("summary"))
    found = F.coalesce(*(F.when(ok(s), read(s)) for s in (answer, fenced, braces)))
    empty = F.array().cast("array<string>")
    part = lambda x, name: F.coalesce(F.get_json_object(x, f"$.{name}"), F.lit("")).alias(name)
    quote = lambda q: F.when(q.startswith("{"), F.struct(part(q, "text"), part(q, "speaker"))).otherwise(F.struct(q.alias("text"), F.lit("").alias("speaker")))
    chapter = lambda c: F.struct(part(c, "title"), part(c, "text"))
    take = lambda name, other: F.coalesce(found[name], other).alias(name)
    return F.struct(
        F.when(found.isNull(), raw["summary"]).otherwise(F.coalesce(found["summary"], F.lit(""))).alias("summary"),
        take("tldr", F.lit("")), take("key_takeaways", empty), take("who_should_watch", F.lit("")), take("who_can_skip", F.lit("")), take("action_steps", empty),
        F.transform(F.coalesce(found["best_quotes"], empty), quote).alias("best_quotes"),
        F.transform(F.filter(F.coalesce(found["chapters"], empty), lambda c: c.startswith("{")), chapter).alias("chapters"),
    )


def highlight_rows(answer: Column, score: float = 0.5) -> Column:
    """(start, end, score) of a model's JSON list of highlights, bare or amid other text: those with a start and an end.

    Numbers may stand as strings; what isn't a number counts as missing.
    """
    kind = "array<struct<start:string,end:string,score:string>>"
    found = F.coalesce(F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), kind), F.array().cast(kind))
    read = F.transform(found, lambda h: F.struct(h["start"].try_cast("double").alias("start"), h["end"].try_cast("double").alias("end"), F.coalesce(h["score"].try_cast("double"), F.lit(score)).alias("score")))
    return F.filter(read, lambda h: h["start"].isNotNull() & h["end"].isNotNull())


def kept_sentences(text: Column, least: int) -> Column:
    """A text's sentences, trimmed, of at least so many words."""
    return F.filter(F.transform(T.sentences(F.trim(text)), lambda s: F.trim(s)), lambda s: T.word_count(s) >= least)


def chapters(sentences: Column) -> Column:
    """Three parts of an array: two of a third of it each, rounded down (one at least), and the rest; empty ones go."""
    n = F.size(sentences)
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))
    cut = lambda a, size: F.slice(sentences, a + 1, F.greatest(size, F.lit(0)))
    parts = F.array(cut(F.lit(0), third), cut(third, third), cut(third * 2, n - third * 2))
    titles = F.array(*map(F.lit, ("Introduction & Overview", "Core Discussion", "Conclusions & Key Points")))
    return F.filter(F.zip_with(titles, parts, lambda t, p: F.struct(t.alias("title"), F.array_join(p, " ").alias("text"))), lambda c: c["text"] != "")
