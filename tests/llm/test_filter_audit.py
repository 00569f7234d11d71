"""The filter interaction audit against a document-by-document simulation of every order."""

import random
import re
from itertools import permutations

from pyspark.sql import types as T

from plumbline.llm import filter_audit

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("part", T.StringType())])


def failed(doc_id, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    }


def plain(rows, labels):
    fails = [failed(i, t or "", rows) for i, t, _ in rows]
    out = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [n for n, (_, _, s) in enumerate(rows) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, name in enumerate(order, 1):
                gone = [n for n in left if fails[n][name]]
                left = [n for n in left if not fails[n][name]]
                lost = [sum(any(label[0] == rows[n][0] is not None and label[k] == 1 for label in labels) for n in gone) for k in (1, 2)]
                redundant = sum(fails[n][name] and any(fails[n][f] for f in order[: step - 1]) for n in mine)
                alone = sum(fails[n][name] and sum(fails[n].values()) == 1 for n in mine)
                shapley[name] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, alone, *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def varied_texts(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        pool = rng.choice([words, words[:40]])
        text = " ".join(rng.choice(pool) for _ in range(rng.choice([150, 199, 200, 260])))
        texts.append(text.upper() if rng.random() < 0.3 else text + rng.choice(["", "", " a|b", " é"]))
    return texts + texts[: n // 3]


def test_every_order_against_simulation(spark, make_docs, odd_texts):
    texts = varied_texts(40) + odd_texts
    rows = [(i * 7 % 101, t, random.Random(i).choice(["a", "b", "b", None, ""])) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "b"), (None, texts[1], None), (rows[5][0], texts[9], "c")]
    labels = [(r[0], i % 2, i % 3 == 0 and 1 or 0, "clash") for i, r in enumerate(rows[:40])] + [(rows[0][0], 1, None, "x"), (rows[0][0], 0, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x")]
    got = filter_audit.audited(make_docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    want = plain(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    for r in got:
        assert [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] == want[r["part"], r["filter_order"], r["step"]], r


def test_no_documents_and_no_labels(spark, make_docs):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audited(make_docs([]), none).collect() == []
    got = filter_audit.audited(make_docs(["x"]), none).where("filter_order = 'CADBE'").orderBy("step").collect()
    assert [(r["removed"], r["kept"], r["shapley"], r["good_lost"]) for r in got] == [(0, 1, 0, 0), (1, 0, 120, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
