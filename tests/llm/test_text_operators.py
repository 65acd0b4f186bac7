"""Toxicity, line dedup, passages and the pipeline."""

import random

import numpy as np
import pytest

from tracequarry.llm import line_dedup, passages, toxicity

SCHEMA = "doc_id long, text string, lang string, id long, place int, doc long, h long"


def frame(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4) for i, t in enumerate(texts, start)], SCHEMA)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(docs, least=line_dedup.LEAST):
    seen, places = [], {}
    out = {}
    for k, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        kept, n = [], 0
        for no, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\n\x0b\x0c\r")
            if not line:
                continue
            n += 1
            if line in places:
                continue
            places[line] = 1
            near = len(line) >= least and any(len(x) >= least and within_one(x, line) for x in seen)
            seen.append(line)
            if not near:
                kept.append(no)
        out[k] = (k, n, len(kept), ",".join(map(str, kept)))
    return sorted(out.values(), key=lambda x: (x[0] is None, x[0]))


def edited(rnd, line):
    i = rnd.randrange(len(line) + 1)
    return rnd.choice([line[:i] + rnd.choice("abß😀") + line[i:], line[: max(0, i - 1)] + line[i:], line[: max(0, i - 1)] + "z" + line[i:]])


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("abcdé  ") for _ in range(rnd.choice([3, 15, 16, 17, 18, 31, 32, 33, 60, 200]))) for _ in range(60)] + ["x" * 40, "x" * 41, "ab" * 20, "page 1 of the longer book", "page 2 of the longer book"]
    pool = lines + [edited(rnd, x) for x in lines for _ in range(3)] + [edited(rnd, edited(rnd, x)) for x in lines]
    texts = ["\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))) for _ in range(80)] + [None, "", "\n\n", " \t\n  ", "page 3 of the longer book"]
    docs = frame(spark, texts).repartition(5)
    got = sorted(map(tuple, line_dedup.report(docs).collect()))
    assert got == brute_lines(list(enumerate(texts)))
    assert line_dedup.report(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs).collect()}
    for k, _, _, own in got:
        t = texts[k]
        if t is None:
            assert kept[k] is None
        else:
            wanted = {int(x) for x in own.split(",") if x}
            assert kept[k] == "\n".join(x for i, x in enumerate(t.split("\n")) if i in wanted or not x.strip())


def test_lines_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, line_dedup.report(docs).collect())) == brute_lines(rows)


def made_words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_passages_are_found(spark):
    rnd = random.Random(7)
    shared, fuzzy, half = made_words(rnd, 60), made_words(rnd, 120), made_words(rnd, 70)
    other = list(fuzzy)
    for i in (20, 47, 80, 101):
        other[i] = "changed"
    other[60:60] = ["two", "more"]
    texts = [
        " ".join(made_words(rnd, 90) + shared + made_words(rnd, 50)),
        " ".join(made_words(rnd, 300)),
        " ".join(made_words(rnd, 20) + shared + made_words(rnd, 70) + fuzzy + made_words(rnd, 9)),
        " ".join(other + made_words(rnd, 44)),
        None, "", "a few words", " ".join(["again"] * 3000),
        " ".join(made_words(rnd, 30) + half[:35] + made_words(rnd, 30)),
        " ".join(made_words(rnd, 10) + half + made_words(rnd, 10)),
        " ".join(half + made_words(rnd, 10)),
    ]
    docs = frame(spark, texts)
    found = {(r["doc_id"], r["other_id"]): r for r in passages.repeated(docs).collect()}
    assert {(2, 0), (3, 2), (10, 9)} <= set(found) <= {(2, 0), (3, 2), (10, 9), (10, 8)}
    r = found[2, 0]
    assert (r["start"], r["end"], r["other_start"], r["other_end"], r["words"]) == (20, 80, 90, 150, 60)
    r = found[3, 2]
    assert r["start"] <= 3 and 119 <= r["end"] <= 123 and 0.8 <= r["identity"] < 1
    assert passages.repeated(docs.filter("doc_id < 0")).count() == 0


def test_planted_passages_and_clean_documents(spark):
    rnd = random.Random(3)
    common = [made_words(rnd, 55) for _ in range(4)]
    texts = []
    for i in range(120):
        own = made_words(rnd, 150)
        if i % 2:
            own[70:70] = common[i // 2 % 4]
        texts.append(" ".join(own))
    found = passages.repeated(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(120) if i % 2 and i // 2 >= 4}
    assert all(r["other_id"] % 2 and r["words"] >= 55 for r in found)


@pytest.mark.parametrize("seed", range(5))
def test_chaining_is_optimal(seed):
    rnd = random.Random(seed)
    pts = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(30)})
    b, a = [p[0] for p in pts], [p[1] for p in pts]
    got = passages.best_chains(b, a, 1, 0.1)
    assert sorted(i for c in got for i in c) == list(range(len(pts)))
    value = []
    for i in range(len(pts)):
        value.append(max([1.0] + [value[j] + 1 - 0.1 * (b[i] - b[j] + a[i] - a[j]) for j in range(i) if b[j] < b[i] and a[j] < a[i]]))
    own = lambda c: 1 + sum(1 - 0.1 * (b[y] - b[x] + a[y] - a[x]) for x, y in zip(c, c[1:]))
    assert abs(own(got[0]) - max(value)) < 1e-9


def labelled(seed, n):
    rnd = random.Random(seed)
    bad = ["idiot", "worthless", "disgusting", "trash"]
    plain = ["".join(rnd.choice(["th", "er", "an", "on", "ing", "ou"]) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    out = []
    for _ in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(30, 200))]
        y = int(rnd.random() < 0.2)
        for _ in range(rnd.randint(3, 6) * y):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        out.append((" ".join(words), y))
    return out


def test_toxicity_on_unseen_rows(spark):
    rows = labelled(1, 900)
    docs = frame(spark, [t for t, _ in rows] + [None, "", "long " * 50000])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(5000, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs, labels)
    got = toxicity.scored(docs, model).join(docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("held")), "doc_id").collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["score"], rows[r["doc_id"]][1]) for r in got if r["held"] and r["doc_id"] < len(rows)]
    wins = np.mean([a > b for a, y in held if y for b, z in held if not z])
    assert wins > 0.97
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns
    again = toxicity.trained(docs.repartition(7), labels.repartition(3))
    assert again == model


def test_toxicity_without_labels(spark):
    docs = frame(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.trained(docs, none)).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    assert toxicity.scored(docs.limit(0), toxicity.trained(docs, none)).count() == 0


def test_windows_hold_the_whole_text():
    text = "Ab  cd\n" + "x" * 1000 + " é" * 300
    assert b"".join(w.replace(b" ", b"").replace(b"\n", b"") for w in toxicity.windows(text)) == text.lower().replace(" ", "").replace("\n", "").encode()
    assert toxicity.windows("") == toxicity.windows(" \n") == []


def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_contracts import DIR, closed, encode, norm, spans_of, words_hash

    from tracequarry.llm import secrets

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {k: t for k, t in rows.items() if model.score(t) < 0.5}
    best = {}
    for k, t in rows.items():
        n = norm(t)
        if n not in best or (-len(t), k) < (-len(rows[best[n]]), best[n]):
            best[n] = k
    rows = {k: rows[k] for k in best.values()}
    prints = {k: words_hash(t) for k, t in rows.items()}
    root, least = closed(prints, 2), {}
    for k, f in prints.items():
        least[root[f]] = min(k, least.get(root[f], k))
    rows = {k: rows[k] for k in least.values()}
    for k, t in rows.items():
        out, at = "", 0
        for s, _, _, e in spans_of(t):
            if s >= at:
                out += t[at:s] + secrets.MASK
            at = max(at, e)
        rows[k] = out + t[at:]
    got = pipeline.run(spark, DIR).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(whole) == set(rows)
    for k, t in rows.items():
        n, at = len(encode(t)) + 1, 0
        for start, length, total in sorted(whole[k]):
            assert start == at and total == n
            at += length
        assert at == n
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("gap", [40, 60, 100, 600])
def test_passages_around_a_different_middle(spark, gap):
    rnd = random.Random(gap)
    size = max(60, gap * 3 // 2)
    texts, wanted = [], {}
    for n in range(0, 12, 2):
        head, foot = made_words(rnd, size), made_words(rnd, size)
        texts += [" ".join(made_words(rnd, 20) + head + made_words(rnd, gap) + foot + made_words(rnd, 20)) for _ in range(2)]
        wanted[n + 1] = set(range(20, 20 + size)) | set(range(20 + size + gap, 20 + 2 * size + gap))
    found = {}
    for r in passages.repeated(frame(spark, texts)).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(found) == set(wanted) and all(wanted[k] <= found[k] for k in wanted)


def test_common_subsequence_of_wide_gaps():
    rnd = np.random.default_rng(5)
    for n, m in ((7, 9), (80, 60), (700, 650)):
        x, y = rnd.integers(0, 30, n).astype("u8"), rnd.integers(0, 30, m).astype("u8")
        row = [0] * (m + 1)
        for w in x:
            last = row
            row = [0]
            for j in range(m):
                row.append(last[j] + 1 if w == y[j] else max(row[j], last[j + 1]))
        assert passages.agreed(x, y) == row[-1]


def test_passages_of_common_sentences(spark):
    rnd = random.Random(11)
    common = [made_words(rnd, 15) for _ in range(4)]
    whole = sum(common, [])
    texts = [" ".join(made_words(rnd, 40) + common[i % 4] + made_words(rnd, 40)) for i in range(80)]
    texts += [" ".join(made_words(rnd, 30) + whole + made_words(rnd, 30)), *texts[:40], " ".join(made_words(rnd, 50) + whole + made_words(rnd, 9))]
    docs = frame(spark, texts).selectExpr("doc_id * 5000 as doc_id", "text")  # ids far apart
    found = [r for r in passages.repeated(docs).collect() if r["doc_id"] == 121 * 5000]
    assert [(r["start"], r["end"], r["other_id"], r["words"]) for r in found] == [(50, 110, 80 * 5000, 60)]


def test_recall_of_fuzzy_passages(spark):
    rnd = random.Random(13)
    texts, wanted = [], set()
    for n in range(240):
        size, share = rnd.choice([60, 100, 200]), rnd.choice([0.82, 0.85, 0.9, 0.95])
        own = made_words(rnd, size)
        changed = set(rnd.sample(range(1, size - 1), int(size * (1 - share))))
        texts += [" ".join(made_words(rnd, 50) + [f"x{n}-{i}" if side and i in changed else w for i, w in enumerate(own)] + made_words(rnd, 50)) for side in (0, 1)]
        wanted.add((2 * n + 1, 2 * n))
    found = {(r["doc_id"], r["other_id"]) for r in passages.repeated(frame(spark, texts)).collect()}
    assert found <= wanted
    assert len(found) >= 0.95 * len(wanted), len(found) / len(wanted)
