import random
import re
from collections import Counter

import numpy as np

from palimpsest.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(covered)


def test_base_figures():
    rng = random.Random(1)
    texts = ["", None, "a a a a", "a b c a b c", "x\ny\nx\n\n \n \nx", "é|日 <b> #", "a b c d a b c"]
    texts += ["".join(rng.choice("ab c\nd|é\t") for _ in range(rng.randint(0, 120))) for _ in range(400)]
    for t in texts:
        data = (t or "").encode()
        assert quality.base(data, data.split()) == brute(t), t


def corpus(spark, n=240):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "river", "runs", "by", "a", "quiet", "town", "and", "hills", "of", "green", "light"]) + ("" if rng.random() < 0.9 else str(rng.randrange(50))) for _ in range(80)) for _ in range(n)]
    poor = [" ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "click###", "free%%%"]) + str(rng.randrange(30)) for _ in range(80)) for _ in range(n // 3)]
    rows = [(i, t) for i, t in enumerate(good + poor)]
    marks = [(i, int(i < n)) for i, _ in rows if i % 2]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"), n


def test_ratio_and_verdicts(spark):
    docs, marks, n = corpus(spark)
    table = quality.ratios(docs, marks)
    # the same counts in plain Python
    good = {r["of"] for r in quality._labelled(marks).where("good and not held").collect()}
    raw, trusted = np.zeros(2 * quality.BUCKETS), np.zeros(2 * quality.BUCKETS)
    for r in docs.collect():
        own = np.concatenate(quality.grams(r["text"].encode().split()))
        np.add.at(raw, own, 1)
        if r["doc_id"] in good:
            np.add.at(trusted, own, 1)
    for part in (slice(0, quality.BUCKETS), slice(quality.BUCKETS, None)):
        want = np.log(trusted[part] + quality.SMOOTHING) - np.log(raw[part] * trusted[part].sum() / raw[part].sum() + quality.SMOOTHING)
        assert np.allclose(table[part], want)
    rows = quality.rate(docs, marks).collect()
    assert len(rows) == docs.count()
    failed = {r["doc_id"] for r in rows if r["base_failed"]}
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert all(i in kept for i in range(n) if i not in failed)
    assert not any(i in kept for i in range(n, docs.count()))


def test_awkward_rows(awkward, nothing, labels):
    rows = quality.rate(awkward, labels).collect()
    assert len(rows) == awkward.count()
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
    assert quality.rate(nothing, labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.rate(awkward, labels.limit(0)).collect())
