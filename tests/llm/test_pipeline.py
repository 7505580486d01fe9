"""The pipeline against a plain version of itself, and the subpackage's independence."""

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline

REPO = Path(__file__).resolve().parents[2]
EN, ES = "the of and to in that house river walk green stone window".split(), "el de la que casa verde ciudad piedra ventana agua monte niño".split()


def speak(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ing" if words is EN else "ado"]) + rng.choice(["", "x", "tion" if words is EN else "ción"]) for _ in range(n))


def shingles(t):
    w = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", t.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    item = speak(rng, EN, 40)
    texts = [speak(rng, (EN, ES)[i % 2], rng.randrange(30, 90)) for i in range(120)]
    texts[10] = texts[3]
    w = texts[5].split()
    w[7] = "changed"
    texts[20] = " ".join(w)
    texts[30] = speak(rng, EN, 20) + " " + " ".join(item.split()[20:] + item.split()[:20])
    texts[40] += " write to some.one@mail.example.com or +1 (555) 123-4567"
    texts[50], texts[51], texts[52] = None, "123 456 ...", ""
    rows = [(i, t, ("en", "es")[i % 2], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {i: t for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    bags, gone = {i: shingles(t) for i, t in left.items()}, set()
    for i in left:
        for j in left:
            if j < i and (n := sum((bags[i] & bags[j]).values())) and n >= 0.8 * sum((bags[i] | bags[j]).values()):
                gone.add(i)
    assert {10, 20} <= gone
    left = {i: t for i, t in left.items() if i not in gone and i != 30}
    left[40] = left[40].replace("some.one@mail.example.com", "[EMAIL]").replace("+1 (555) 123-4567", "[PHONE]")

    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, str(tmp_path))
        if k < 4:
            assert stage.columns == docs.columns, name
            stage.write.parquet(str(tmp_path / name))
            stage = spark.read.parquet(str(tmp_path / name))
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "personal_data")).collect()}
    assert got == left
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(left[r["doc_id"]] == r["text"] for r in mixed)
    size, taken, all_ = {i: len(t.split()) for i, t in left.items()}, Counter(), Counter()
    for r in mixed:
        taken[r["source"]] += size[r["doc_id"]]
    for i, n in size.items():
        all_[f"s{i % 4}"] += n
    assert all(taken[s] <= 2 * all_[s] for s in all_) and abs(sum(taken.values()) - 1.5 * sum(all_.values())) < 0.05 * sum(all_.values())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """The driver's contract can be imported, and lists the other queries, where the subpackage and the pipeline are gone."""
    for name in ("__spark_entry__.py",):
        (tmp_path / name).write_text((REPO / name).read_text())
    package = tmp_path / "tallyforge"
    for p in (REPO / "tallyforge").rglob("*.py"):
        if "llm" not in p.parts:
            to = package / p.relative_to(REPO / "tallyforge")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') for x in q) and len(q) > 90 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
