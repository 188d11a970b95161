"""Line-first quality rules against a plain version."""

import random
import re

from flagstone.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    n_repeat = len(inside)
    failed = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, failed)


def texts():
    rng = random.Random(2)
    vocab = ["a", "bé", "ccc", "😀x", "#1", "|", "d.", "the"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    out += ["\n".join(rng.choice(["one two", "one two ", "three", "", "\t"]) for _ in range(12)) for _ in range(30)]
    out += [None, "", " \n\t", "a b c d e " * 3000, "\x0b\x0c\r\n", "w" * 200000]
    return out


def judged(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)], "doc_id long, text string, n_words string, quality_ int")
    return quality.judge(docs, **kw)


def test_measures_equal_plain_version(spark):
    fields = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    got = {r[0]: tuple(r[1:]) for r in judged(spark, texts()).select("doc_id", *fields).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts())}


def test_rules_by_line(spark):
    prose = "This is a line of plain words that stays where it is."
    bad = ["a | b | c | d", "Home", "ALL SHOUTED!! WORDS!! HERE!!", "x### y$$$ z%%% w&&&", "2024 1234 !!", "We use this under our Cookie Policy."]
    good = [prose, "a short line", "Preis: 20 % weniger, sagt der Händler.", "Oui ! Non ! Si !", "", "HEADLINE IN CAPITALS"]
    rows = spark.createDataFrame([(x,) for x in bad + good], "line string")
    from pyspark.sql import functions as F

    failed = {r[0] for r in rows.filter(quality.line_fails(F.col("line"), 0.15)).collect()}
    assert failed == set(bad)


def test_verdict_and_cleaned_text(spark):
    prose = " ".join(f"word{i}" for i in range(30))
    menu = "\n".join(f"item{i} | thing{i} | more{i} | rest{i}" for i in range(40))
    tail, repeat = "and a tail of other words", prose[:40]  # the tail's windows come once, the repeat's twice
    rows = [prose, f"{prose}\nHome\n{tail}", f"{prose}\nHome\n{repeat}", f"{prose}\n{menu}", "too few words"]
    got = [tuple(r) for r in judged(spark, rows).orderBy("doc_id").select("quality.kept", "quality.clean_text").collect()]
    assert got == [(True, prose), (True, f"{prose}\n{tail}"), (False, f"{prose}\n{repeat}"), (False, prose), (False, "too few words")]


def test_plan_is_native_and_has_no_shuffle(spark):
    plan = judged(spark, texts())._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_empty_table(spark):
    assert judged(spark, texts()).limit(0).collect() == []


def test_clashing_names_stay(spark):
    names = ["__text", "__words", "__lines", "__m", "___m"]
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5, *names)], "doc_id long, text string, Quality int, " + ", ".join(f"{n} string" for n in names))
    got = quality.judge(docs).first()
    assert [got[n] for n in names] == names and got["quality"]["kept"] and got["quality"]["clean_text"] == text
    assert got.asDict().keys() == {"doc_id", "text", "quality", *names}
