import math
import random
from collections import Counter

import numpy as np

from shabdagrid.llm.stuffing import fit_curves, frequent_words, judge_pages, page_points, page_words

PROSE = "In the older books the refrain of the river follows the hymn of its singer. Whether the altar repeats the verse is a question that the commentary leaves open. "
NOUNS = "river hymn singer altar verse dawn horse bridge layer metre gloss accent guest king storm rain".split()


def pages():
    rnd = random.Random(4)
    prose = [" ".join(PROSE.replace("river", rnd.choice(NOUNS)).replace("altar", rnd.choice(NOUNS)) for _ in range(rnd.randint(1, 4))) for _ in range(120)]
    bad = [
        " ".join(rnd.choice(["buy", "lamp", "cheap", "online"]) for _ in range(90)),
        ", ".join(f"#tag{i}x" for i in range(40)),
        "\n".join(f"[lamp {i}](https://shop{i}.example.com/p?id={i})" for i in range(30)),
        "\n".join(f"Brass {rnd.choice(NOUNS)} {i} mm - Rs {i * 7} - SKU {i + 4000} - Sold out" for i in range(30)),
        "Home » Archive » More » Login » " * 20,
        "https://a.example.com/1 https://b.example.com/2 https://c.example.com/3",
    ]
    good = [prose[0] + "\nTags: #one #two #three", "word", "", " ", None, "the " * 5, "See https://a.example.com/1"]
    return prose + good, bad


def test_stuffed_pages_are_found(spark):
    good, bad = pages()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + bad)], "doc_id long, text string, language string")
    found = {r["doc_id"] for r in judge_pages(df, "doc_id", "text").where("stuffed").collect()}
    assert found == set(range(len(good), len(good) + len(bad)))
    assert judge_pages(df.limit(0), "doc_id", "text").count() == 0


def test_measures_against_brute_force(spark):
    good, _ = pages()
    text = good[3]
    df = spark.createDataFrame([(1, text), (2, good[4])], "doc_id long, text string")
    words = page_words(df, "doc_id", text="text")
    frequent = frequent_words(words, 5)
    both = [set("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in (text, good[4])]
    df_of = Counter(w for b in both for w in b)
    assert frequent["latin"] == sorted(df_of, key=lambda w: (-df_of[w], w))[:5]
    r = fit_curves(page_points(words, "doc_id", frequent), "doc_id").where("doc_id = 1").first()
    tokens = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    f = Counter(tokens)
    assert r["n"] == len(tokens) and r["distinct_words"] == len(f) and r["n_frequent"] == sum(f[w] for w in frequent["latin"])
    x, y, k, upto = [], [], [], 0
    for freq, c in sorted(Counter(f.values()).items(), reverse=True):
        x.append(0.5 * (math.log(upto + 1) + math.log(upto + c)))
        y.append(math.log(freq))
        k.append(c * freq)
        upto += c
    slope, intercept = np.polyfit(x, y, 1, w=np.sqrt(k))
    assert abs(r["slope"] - slope) < 1e-9 and abs(r["intercept"] - intercept) < 1e-9
