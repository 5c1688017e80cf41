import math
import re

from trackmill.llm import licenses


def brute(text):
    words = [w for w in re.split(licenses.SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += at
        if at:
            base.add(label)
            labels.add(label)
            score = 1.0
    width = licenses.STRIDE + max(len(p.split()) for p, _ in licenses.PHRASES + licenses.NOTICES) - 1
    for k in range(max(len(words) - 1, 0) // licenses.STRIDE + 1):
        block = set(words[k * licenses.STRIDE : k * licenses.STRIDE + width])
        for notice, label in licenses.NOTICES:
            t = set(notice.split())
            if len(t & block) >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9):
                labels.add(label)
                score = max(score, len(t & block) / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def test_against_brute_force(spark):
    filler = " ".join(f"w{i}" for i in range(63))
    rows = [
        (1, "Released under the MIT License."), (2, "mit. LICENSE mit license"), (3, None), (4, ""), (5, "!!"), (6, filler + " mit license"), (7, filler + " x general public license apache license"), (8, licenses.NOTICES[2][0].upper()),
        (9, " ".join(licenses.NOTICES[2][0].split()[:12])), (10, filler + " " + licenses.NOTICES[4][0]), (11, "Apache\nLicense Version 2.0, licensed under the"), (12, "émit license"), (13, "mit license " * 5000), (14, "mit"), (14, "mit license"), (14, "mit license"), (None, "mit license"),
    ]
    df = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id long, text string, words string, k_id int")
    got = [(*tuple(r)[:-1], round(r.score, 9)) for r in licenses.scan_licenses(df, licenses.template_table(spark)).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert licenses.scan_licenses(df.limit(0), licenses.template_table(spark)).count() == 0
