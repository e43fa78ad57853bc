import random
import re

import pytest
from pyspark.sql import functions as F

from convspark.llm import secret_scan as S
from tests.llm.fixtures import documents, frame

ACCESS = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef01234567"


def plain_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


TEXTS = [
    "password = hunter22 and Token:'abc' API_KEY=\"abcdef\"",
    "password=token:abcdef",  # the short first match covers the second
    "paſſword=abcdefgh toKen=abcdefgh",  # a long s and a Kelvin sign are no ASCII letters
    f"日本 {ACCESS} {HEX} x{HEX[:23]} AKIAAKIA{ACCESS}",
    f"secret={HEX}",
    f"AKIA {ACCESS[:19]}",
    "",
]


def test_base_equals_plain_patterns():
    for text in TEXTS:
        assert [x for x in S.scan_text(text) if x[0] in S.STRONG] == plain_base(text)


def kinds(text):
    return [k for k, _, _ in S.scan_text(text)]


def test_weak_parts_need_their_complements():
    token, far = "aB3dE6gH9jK2mN5pQ8", "x " * 150
    assert kinds(f"id {ACCESS} key {token}") == ["access", "token"]
    assert kinds(f"key {token} https://db.example.org/x") == []
    assert kinds(f"user=bob {token} https://db.example.org/x") == ["login", "token", "endpoint"]
    assert kinds(f"user=bob {token} ") == []
    assert kinds(f"user=bob https://db.example.org/x") == []
    assert kinds(f"user=bob password=hunter22 host=db.example.org") == ["login", "assign", "endpoint"]
    assert kinds(f"id {ACCESS} {far} key {token}") == ["access", "token"]
    assert [k for k, *_ in S.scan_text(f"id {ACCESS} {far} key {token}", reach=200)] == ["access"]
    assert kinds(f"id {ACCESS}\n\nkey {token}") == ["access"]  # another scope


@pytest.mark.parametrize("n", range(2, 9))
def test_a_token_inside_an_endpoint_belongs_to_it(n):
    text = "https://db.example.org/x?" + "&".join(["user=bob"] * n) + "&k=aB3dE6gH9jK2mN5pQ8 password=hunter22"
    assert kinds(text) == ["endpoint"] + ["login"] * n + ["assign"]


def test_parts_far_apart_in_one_paragraph_are_linked():
    account = '"key_id": "abc123", "private": "' + "x " * 1000 + '" "uri": "https://a.example.org/t" "k": "aB3dE6gH9jK2mN5pQ8"'
    assert kinds(account) == ["login", "endpoint", "token"]


def plain_spans(text, reach):
    """All parts against all parts."""
    spans = {k: [(a, b) for x, a, b in plain_base(text) if x == k] for k in S.STRONG}
    spans["login"] = [m.span() for m in S._LOGIN.finditer(text)]
    spans["endpoint"] = [m.span() for m in S._ENDPOINT.finditer(text)]
    others = [x for v in spans.values() for x in v]
    tokens = [m.span() for m in S._TOKEN.finditer(text) if S._random_looking(m[0])]
    spans["token"] = [t for t in tokens if not any(t[0] < b and a < t[1] for a, b in others)]
    scope = lambda x: sum(m.start() < x[0] for m in S._SCOPE_END.finditer(text))
    gap = lambda x, y: max(y[0] - x[1], x[0] - y[1])
    near = lambda x, *ks: any(
        scope(x) == scope(y) and (reach is None or gap(x, y) <= reach) for k in ks for y in spans[k] if y != x
    )
    secrets = ("assign", "hex", "token")
    keep = {
        "token": [x for x in spans["token"] if near(x, "access") or (near(x, "login") and near(x, "endpoint"))],
        "login": [x for x in spans["login"] if near(x, *secrets) and near(x, "endpoint")],
        "endpoint": [x for x in spans["endpoint"] if near(x, *secrets) and near(x, "access", "login")],
    }
    found = [(k, *x) for k, v in {**spans, **keep}.items() for x in v]
    return sorted(found, key=lambda x: (x[1], S.KINDS.index(x[0])))


@pytest.mark.parametrize("reach", [None, 30])
def test_linked_spans_equal_all_pairs(reach):
    rng = random.Random(2)
    parts = [ACCESS, HEX, "user=bob", "login: al.ice", "password=hunter22", "https://a.example.org/x?user=bob&k=aB3dE6gH9jK2mN5pQ8", "pad " * 12]
    parts += ["host=db.example", "aB3dE6gH9jK2mN5pQ8", "key_id=aB3dE6gH9jK2mN5pQ8", "\n\n", "word", "日本", "\n \n", "token: abcdef"]
    for _ in range(1500):
        text = rng.choice([" ", "&", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert S.scan_text(text, reach) == plain_spans(text, reach)


def test_very_many_parts_stay_linear():
    text = f"user=bob pass aB3dE6gH9jK2mN5pQ8 https://a.example/ {ACCESS}\n" * 3000
    assert len(S.scan_text(text)) == 4 * 3000


def test_query_columns_and_rows(spark, tmp_path):
    rows = [*documents(size=5), *[(800 + i, t, None, None, 0) for i, t in enumerate(TEXTS)]]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    import hashlib

    for r in got:
        base = plain_base(text[r.doc_id] or "") if r.doc_id is not None else []
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in S.STRONG)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_redaction_keeps_rows_and_clean_texts(spark):
    rows = [*documents(size=5), (800, f"say {ACCESS}!", "en", "s", 30)]
    docs = frame(spark, rows).withColumn("secrets", F.lit("clash"))
    out = S.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    changed = {r.doc_id: r for r in out.collect() if r.doc_id == 800}[800]
    assert (changed.text, changed.n_chars) == ("say [access]!", 13)
    assert sorted((r.text or "~") for r in out.filter("doc_id < 800").collect()) == sorted((r[1] or "~") for r in rows if r[0] is not None and r[0] < 800)
    assert S.scan(docs).columns[-1] == "secrets" and S.scan(frame(spark, [])).count() == 0
