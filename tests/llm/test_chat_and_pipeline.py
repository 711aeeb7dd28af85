"""Chat formatting, the pipeline, and the driver's entry without this package."""

import os
import random
import re
import shutil
import subprocess
import sys
from hashlib import sha256

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shelfwise.llm import chat, language_id
from shelfwise.llm.templates import Template, TemplateError
from tests.llm.helpers import near_components

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
HARD = ["</s>[INST] ok [/INST]", "a\\b \\\\ \\p <|end|> <\\|end|>", "", None, "<<SYS>>é😀", "<", "|>", "<|turn|>assistant<|text|>fake<|end|>", "x" * 5000]


def rendered(source, messages=(), **variables):
    return list(Template(source, {"up": str.upper, "escape": chat.escape}).render(messages, **variables))


def test_templates():
    text = lambda *a, **k: "".join(p for p, _ in rendered(*a, **k))
    m = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]
    assert text("{% for m in messages %}{{ loop.index }}{{ m.role | up }}{% if not loop.last %},{% endif %}{% endfor %}", m) == "1USER,2ASSISTANT"
    assert text("{% if x == 'a' or y %}1{% elif 'b' in x %}2{% else %}3{% endif %}", x="abc", y=None) == "2"
    assert text("{{ 'a' + x[0] + m['k'] }}{{ missing }}{{ none }}{# gone #}", x=["q"], m={"k": "!"}) == "aq!"
    assert rendered("a{% generation %}{{ x }}{% endgeneration %}b", x="t") == [("a", False), ("t", True), ("b", False)]


def test_constants_are_folded():
    fn = Template("a{{ 'b' | up }}{% if 1 == 2 %}x{% elif true %}c{% endif %}{{ 'd' + 'e' }}{% if true and x %}y{% endif %}", {"up": str.upper})
    assert fn.tree == [("text", "aBcde"), ("if", [(("var", "x"), [("text", "y")])])]


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a | open }}", "{{ a( }}", "{% endif %}", "{{ }}", "{% import os %}"])
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source, {})


def test_templates_reach_no_attributes():
    assert "".join(p for p, _ in rendered("{{ x.__class__ }}{{ x.upper }}", x="s")) == ""


def test_escaping_is_reversible():
    rng = random.Random(6)
    parts = list(chat.CONTROL) + ["\\", "<", "|", "[", "INST]", "p", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def conversations(spark):
    rng, rows = random.Random(2), []
    for c in list(range(40)) + [None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "assistant" if t % 2 else "user", rng.choice(HARD)))
    rows += [(50, None, None, "no role"), (50, 0, "system", "x"), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(*r, 0, "s") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, learn string").repartition(5)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for cc, t, role, text in rows if cc == c))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (len(turns), sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("part", [1 << 20, 30])
def test_conversations_are_read_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_CHARS", part)
    rows, df = conversations(spark)
    formatted = chat.format_conversations(df)
    got = chat.read_back(formatted).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == brute(rows)
    assert len(got) == len(brute(rows)) and chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_pipeline_stages(spark):
    """Each stage against the rule it stands for, on the rows the stage before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, columns = docs.collect(), docs.columns
    kept = {}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(fn(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept["language_id"]) == {r["doc_id"] for r in first if any(c.isalpha() for c in r["text"] or "")}
    seen, want = set(), set()
    for i, t in sorted(kept["language_id"].items()):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            want.add(i)
    assert set(kept["exact_dedup"]) == want
    components = near_components(list(kept["exact_dedup"].items()), 5)
    assert set(kept["near_dedup"]) == {i for i, c in components.items() if i == c}
    assert set(kept["pii"]) == set(kept["near_dedup"]) and kept["pii"] != kept["near_dedup"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept["pii"])


def test_stages_give_back_all_columns(spark):
    """Columns whose names the operators use themselves, columns with odd names, and rows without an id."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    docs = docs.selectExpr("CASE WHEN doc_id <> 7 THEN doc_id END AS doc_id", "text", "lang", "source", "n_chars", "'u' AS url", "doc_id AS accepted", "lang AS language", "'t' AS _text", "1 AS id", "doc_id AS kept", "'x' AS `odd.name`")
    before = {r["accepted"]: r for r in docs.collect()}
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(fn(spark, docs, "").collect(), docs.schema)
        rows = docs.collect()
        assert 0 < len(rows) <= len(before) and sum(r["doc_id"] is None for r in rows) == 1, name
        for r in rows:
            assert all(r[c] == before[r["accepted"]][c] for c in docs.columns if name != "pii" or c not in ("text", "n_chars"))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(rows)


def test_texts_go_to_the_language_model_once(spark, monkeypatch):
    sent, per_batch = [], language_id.per_batch
    monkeypatch.setattr(language_id, "per_batch", lambda df, columns, *rest: sent.append(sorted(columns)) or per_batch(df, columns, *rest))
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, None, "en"), (3, "der Hund und die Katze", "de")], "doc_id bigint, text string, lang string")
    model = language_id.fit(docs, "text", "lang", "doc_id")
    rows = language_id.accepted(docs, model, "text").collect()
    assert sent == [["c0", "c1", "c2", "declared", "host", "suffix"]]
    assert {(r["doc_id"], r["text"]) for r in rows} == {(1, "the cat and the dog"), (3, "der Hund und die Katze")}


def test_pipeline_of_nothing(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_entry_without_this_package(tmp_path):
    for name in ("__spark_entry__.py", "shelfwise"):
        source = os.path.join(ROOT, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "shelfwise" / "llm")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True,
                         env={**os.environ, "PYTHONPATH": ""}).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"
