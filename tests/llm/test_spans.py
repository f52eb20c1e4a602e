import base64
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import personal, secrets

from llm_samples import AWKWARD, documents

PARTS = ["a", "b.", "@", "1", "25", "0", ".", " ", "-", "+", "(", ")", "x@y.de", "1.2.3.4", "4111111111111111", "é",
         "+1 838 555-9577", "_", "%", ".c", "4111-1111 1111 1111", "AKIA", "B7", "password", "Token", "api_key", " = ",
         ":", "'", '"', "0123456789abcdef" * 2, "deadbeef" * 3, "PASSWD", "="]


def personal_by_contract(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19),
                                       ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            if least <= len(digits) <= most and (kind == "phone" or odd % 10 == 0):
                out.append((kind, *m.span()))
    return out


def secrets_by_contract(text):
    assign = (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_equal_the_contract():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert personal.base_spans(text) == personal_by_contract(text), text
        assert secrets.base_spans(text) == secrets_by_contract(text), text


def test_long_texts_take_linear_time():
    model = personal.fit(["a@b.cd and 1.2.3.4"])
    for text in ("1" * 200_000, "a." * 100_000, "+1(" * 60_000, "1 " * 100_000, "a@" * 100_000, "a@b.c " * 20_000):
        personal.add_spans([text], model)
        secrets.all_spans(text)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    texts = []
    for i in range(200):
        number = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        texts.append(f"Write to ann.{i}@mail{i % 9}.example.com or call {number}, from 10.0.{i}.7, order 55{i:05d}.")
    return personal.fit(texts)


def test_similar_tokens_carry_labels_over_distance(model):
    text = ("Call +1 (838) 555-9577 now. Mail una.89@mail7.example.com. " + "filler words here " * 40
            + "Again 838-555-9577 or una.89@mail7, but order 5551234567 is none.")
    added = [(k, text[a:b]) for k, a, b, base in personal.add_spans([text], model)[0] if not base]
    assert ("phone", "838-555-9577") in added and ("email", "una.89@mail7") in added
    assert not any("5551234567" in t for _, t in added)


@pytest.mark.parametrize("count", [1, 5, 13, 50, 1000])
def test_labels_reach_all_repeats(count):
    import numpy as np

    # Shapes speak for nothing, repeats say little, similar tokens much.
    model = {"node": np.zeros((len(personal.node_features("x")), 5)), "pairs": np.zeros((3, 5, 5))}
    model["node"][0, 0] = 2.0
    model["pairs"][2] = np.diag([0.0, 3.0, 3.0, 3.0, 3.0])
    model["pairs"][1] = 0.4 * np.eye(5)
    full = "call +1 (838) 555-9577 or una.89@mail7.example.com"
    for bare in ("838-555-9577", "una.89@mail7"):
        many = " and then ".join([bare] * count)
        for text in (f"{full}; {many}", f"{many}; {full}"):
            assert sum(not base for *_, base in personal.add_spans([text], model)[0]) == count


def test_documents_settle_by_themselves():
    import numpy as np

    rng = np.random.default_rng(2)
    weights = rng.normal(size=(3, 5, 5))
    nodes, chain = rng.normal(size=(60, 5)), [(i, i + 1, i % 3) for i in range(49)]
    pair = [(50, 51, 2)]
    both = personal.pass_messages(
        nodes, np.array(chain + pair), weights, documents=np.repeat([0, 1], [50, 10]))
    assert np.allclose(both[:50], personal.pass_messages(nodes[:50], np.array(chain), weights), atol=1e-12)
    assert np.allclose(both[50:], personal.pass_messages(nodes[50:], np.array([(0, 1, 2)]), weights), atol=1e-12)


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    texts = [f"call +1 (838) 555-{i:04d}" for i in range(20)]
    small = next(r.text for r in spark.createDataFrame([(t,) for t in texts], "text string").orderBy(
        personal.F.xxhash64("text")).limit(1).collect())
    monkeypatch.setattr(personal, "fit", lambda found: found)
    found = personal.fitted(documents(spark, [*texts, *[small] * 50]).repartition(4), documents=12)
    assert len(found) == len(set(found)) == 12 and small in found


def test_without_observed_labels_nothing_is_added(model):
    assert personal.add_spans(["numbers 838-555-9577 and 1234 5678 alone"], model) == [[]]


def test_messages_agree_with_exact_marginals():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    nodes, weights = rng.normal(size=(3, 5)), rng.normal(size=(3, 5, 5)) * 0.5
    edges = np.array([[0, 1, 0], [1, 2, 2]])
    exact = np.zeros((3, 5))
    for labels in itertools.product(range(5), repeat=3):
        p = np.exp(sum(nodes[i, y] for i, y in enumerate(labels))
                   + sum(weights[t, labels[i], labels[j]] for i, j, t in edges))
        for i, y in enumerate(labels):
            exact[i, y] += p
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(personal.pass_messages(nodes, edges, weights, rounds=200), exact, atol=1e-3)


def test_documents_are_searched_and_redacted_row_by_row(spark, model):
    texts = [*AWKWARD, "é a@b.cd 10.0.0.1 x", "same a@b.cd", "same a@b.cd"]
    docs = documents(spark, texts, kind="k", start=1).repartition(2)
    found = {r.doc_id: r for r in personal.find_personal_data(docs, model).collect()}
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i]._spans if s.base] == personal_by_contract(text or "")
    clean = {r.doc_id: r for r in personal.redact_documents(docs, model).collect()}
    assert clean[len(AWKWARD)].text == "é [EMAIL] [IP] x"
    for i, text in enumerate(texts):
        assert clean[i].n_chars == (None if text is None else len(clean[i].text))
        if not found[i]._spans:
            assert clean[i].text == text
    assert personal.redact_documents(docs.limit(0)).count() == 0


def test_redaction_joins_overlaps():
    assert personal.redacted("abcdefgh", [("ip", 1, 4), ("card", 2, 6), ("email", 7, 8)]) == "a[IP]g[EMAIL]"


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x82]) + size.to_bytes(2, "big")
    return bytes([tag]) + head + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, b"".join(map(integer, (0, *[(3 << 1000) + i for i in range(8)]))))
PKCS8 = der(0x30, integer(0) + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, b"k" * 32)))
SEC1 = der(0x30, integer(1) + der(4, b"s" * 32) + der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
PUBLIC = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d010101"))) + der(3, b"\0" * 80))


def openssh():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return (b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big")
            + field(b"public" * 8) + field(b"private" * 16))


@pytest.mark.parametrize("data, good", [
    (RSA, True), (PKCS8, True), (SEC1, True), (openssh(), True), (PUBLIC, False), (RSA[:-1], False),
    (RSA + b"\0", False), (der(0x30, b"\0" * 60), False), (openssh()[:-3], False), (b"", False)])
def test_keys_are_confirmed_by_nested_lengths(data, good):
    assert secrets.private_key(data) == good
    text = f"key {base64.b64encode(data).decode()} end" if len(data) > 40 else "none"
    assert bool(secrets.confirmed_spans(text)) == (good and len(data) > 40)
    if good:
        assert secrets.confirmed_spans(f"x {data.hex()} y") == ([("key", 2, 2 + 2 * len(data))] if data[0] == 0x30 else [])
        body = base64.encodebytes(data).decode()
        pem = f"-----BEGIN PRIVATE KEY-----\n{body}-----END PRIVATE KEY-----"
        assert secrets.confirmed_spans("a " + pem) == [("key", 2, 2 + len(pem))]


@pytest.mark.parametrize("data", [RSA, PKCS8 + b"", SEC1, openssh()])
@pytest.mark.parametrize("width", [44, 64, 76])
def test_keys_over_escaped_and_real_lines(data, width):
    plain = base64.b64encode(data).decode()
    lines = [plain[i : i + width] for i in range(0, len(plain), width)]
    armour = "\n".join(["-----BEGIN PRIVATE KEY-----", *lines, "-----END PRIVATE KEY-----"])
    for escaped in (json.dumps(armour)[1:-1], json.dumps(json.dumps(armour))[3:-3], armour.replace("\n", "\\r\\n")):
        assert secrets.confirmed_spans(f'"{escaped}\\n"') == [("key", 1, 1 + len(escaped))]
    for end in ("\n", "\r\n", "\n  ", "\\n"):
        body = end.join(lines)
        for behind in ("", "\nwords", " words", '"'):
            want = [("key", 2, 2 + len(body))] if len(lines[0]) >= 40 else []
            assert secrets.confirmed_spans(f"k {body}{behind}") == want
    if len(lines) > 1:
        assert secrets.confirmed_spans("k " + "\n".join(lines[:-1])) == []


def test_escaped_and_wrapped_lines_take_linear_time():
    line = "MI" + "A" * 62
    for text in (f"{line}\n" * 5_000, "-----BEGIN PRIVATE KEY-----\\n" * 10_000, "A\\n" * 100_000):
        secrets.all_spans(text)


def token(header, payload):
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(header)}.{part(payload)}.c2lnbmF0dXJl"


@pytest.mark.parametrize("text, good", [
    (token({"alg": "HS256", "typ": "JWT"}, {"sub": "1"}), True), (token({"typ": "JWT", "x": 1}, {"sub": "1"}), False),
    (token({"alg": "HS256"}, b"not json at all"), False), (token({"alg": 5, "typ": "JWT"}, {"sub": "1"}), False)])
def test_signed_tokens_are_confirmed_by_their_headers(text, good):
    assert secrets.confirmed_spans(f"see {text}, yes") == ([("token", 4, 4 + len(text))] if good else [])


def test_secrets_of_documents(spark):
    texts = [*AWKWARD, f"é key {base64.b64encode(RSA).decode()}", "password=hunter2hunter2", "AKIA" + "A" * 12]
    found = {r.doc_id: r for r in secrets.find_secrets(documents(spark, texts, kind="k")).collect()}
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i]._spans if s.base] == secrets_by_contract(text or "")
    assert [s.kind for s in found[len(AWKWARD)]._spans] == ["key"]
    assert secrets.find_secrets(documents(spark, ["x"]).limit(0)).count() == 0


def test_folding_of_secrets_is_ascii():
    for text in ("to\u212aen=abcdefgh1", "pa\u017f\u017fword=abcdefgh1", "password pa\u017f\u017fword=abcdefgh1 x"):
        assert secrets.base_spans(text) == []
    assert secrets.base_spans("ToKeN=abcdefgh1") == [("assign", 0, 15)]


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes(
        (size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_wrapped_keys_of_any_length():
    import base64

    word = lambda raw: len(raw).to_bytes(4, "big") + raw
    long = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i]) * 6000) for i in range(8)))
    many = b"openssh-key-v1\0" + word(b"none") + word(b"none") + word(b"") + (20).to_bytes(4, "big") + b"".join(
        word(bytes([i]) * 51) for i in range(20)) + word(b"k" * 3000)
    for key in (long, many):
        assert secrets.private_key(key)
        coded = base64.b64encode(key).decode()
        wrapped = "\n".join(coded[i : i + 64] for i in range(0, len(coded), 64))
        text = f"before\n{wrapped}\nwords behind it\n"
        assert [s for s in secrets.confirmed_spans(text)] == [("key", 7, 7 + len(wrapped))]
        assert secrets.confirmed_spans(text.replace(wrapped[-80:], "")) == []


def test_spans_stand_beside_columns_of_any_name(spark):
    docs = documents(spark, ["token=abcdefgh1", None], _spans="mine", **{"odd name": 1})
    docs = docs.withColumn("nested", F.struct(F.lit(1).alias("a b")))
    found = secrets.find_secrets(docs)
    assert found.columns == [*docs.columns, "__spans"]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[0]["_spans"] == "mine" and len(rows[0]["__spans"]) == 1 and rows[1]["__spans"] == []


def test_personal_data_stands_beside_columns_of_any_name(spark, model):
    docs = documents(spark, ["write to a.b@example.org", None], _spans="mine", **{"odd name": 1})
    docs = docs.withColumn("nested", F.struct(F.lit(1).alias("a b")))
    found = personal.find_personal_data(docs, model)
    assert found.columns == [*docs.columns, "__spans"]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[0]["_spans"] == "mine" and [s.kind for s in rows[0]["__spans"]] == ["email"] and rows[1]["__spans"] == []
    clean = personal.redact_documents(docs, model)
    assert clean.columns == docs.columns
    assert {r.doc_id: (r.text, r["_spans"], r["odd name"]) for r in clean.collect()} == {
        0: ("write to [EMAIL]", "mine", 1), 1: (None, "mine", 1)}
