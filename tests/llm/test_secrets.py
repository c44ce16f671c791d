"""Secret spans against plain regular expressions over whole texts."""

import hashlib
import random
import re

from gridloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEY = re.compile(r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
URL = re.compile(r"https?://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]{1,5})?")


def plain(text, scope=300):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    access = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += access + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    near = lambda s, others: any(abs(s[1] - o[1]) <= scope for o in others)
    all_keys = [("key", m.start(), m.end()) for m in KEY.finditer(text)]
    keys = [k for k in all_keys if near(k, access)]
    partners = all_keys + [b for b in base if b[0] == "assign"]
    urls = [u for u in (("endpoint", m.start(), m.end()) for m in URL.finditer(text)) if near(u, access) and near(u, partners)]
    order = ["assign", "access", "hex", "key", "endpoint"]
    by_place = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0]))))
    return [sum(b[0] == k for b in base) for k in order[:3]] + [hashlib.sha256(by_place(base).encode()).hexdigest(), by_place(base + keys + urls)]


def found(df):
    return {r["doc_id"]: [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]] for r in df.collect()}


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert found(secrets.op10_credential_linking(spark, sf_dir)) == {i: plain(t) for i, t in texts.items()}


def test_made_up_texts(spark):
    """Parts in random order and distance, some of them broken, between texts beyond the first plane."""
    random.seed(11)
    access, key, url = "AKIA" + "Q7" * 8, "aB3/" * 10, "https://s3.example.com:443"
    parts = [access, access[:-1], key, key[:-1], key + "=", url, "http://x", "password: hunter22", 'API_KEY="abc"', "token=" + "z" * 30, "a1" * 12, "a1" * 11, "tokenapi_key=abcdef9", "Secret' = 'x-y_z.q+/=", "AKIAAKIA" + "B2" * 8]
    texts = {}
    for n in range(300):
        words = [random.choice(parts) if random.random() < 0.4 else random.choice(["é", "👍", "word", "\n", " " * random.randint(1, 200)]) for _ in range(random.randint(0, 25))]
        texts[n] = random.choice([" ", "  ", "\n", ", "]).join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(secrets.find_secrets(df)) == {n: plain(t) for n, t in texts.items()}


def test_odd_rows_and_redaction(spark):
    secret = "password: hunter22"
    rows = [(1, None, 0, "r", None), (2, "", 0, "r", "k"), (3, secret, 18, "r", "k"), (3, secret, 18, "r", "k"), (None, f"x {secret} y", 22, None, "k"), (5, "clean é " * 50_000 + secret, 400_018, "r", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, rid string, kind string")
    out = secrets.find_secrets(df).collect()
    assert len(out) == len(rows) and sum(r["n_assign"] for r in out) == 4
    assert [r["spans"] for r in out if r["doc_id"] == 5] == ["assign:400000:400018"]
    masked = secrets.redact(df)
    assert masked.columns == df.columns
    texts = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in masked.filter("text is not null").collect())
    assert texts[0] == (0, "x [SECRET] y", 12) and texts[2:4] == [(3, "[SECRET]", 8)] * 2 and texts[4][1].endswith("é [SECRET]")
    assert masked.filter("text is null").count() == 1
    assert secrets.find_secrets(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).count() == 0
