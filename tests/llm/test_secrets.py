"""Secret scans against plain regular expressions and a plain Markov model."""

import base64
import hashlib
import math
import random
import re

import pytest

pytest.importorskip("strataloom.llm")
from strataloom.llm import secrets  # noqa: E402

KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def rest(text, spans):
    """The text with the spans blanked out kind by kind, each kind as it is found in what is left."""
    for s, _, kind, e in spans:
        if kind == "assign":
            text = text[:s] + " " * (e - s) + text[e:]
    for pattern in (secrets.ACCESS, secrets.HEX):
        text = re.sub(pattern, lambda m: " " * len(m[0]), text)
    return text


def texts():
    rnd = random.Random(3)
    some = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    prose = "the weather in autumn changes quickly and nobody could have foreseen misunderstandings about internationalization responsibilities notwithstanding characteristically".split()
    syllables = "tion ing er an the re in ment con pro ble ly es al or ist ness ward ful able ous ive".split()
    prose += ["".join(rnd.choice(syllables) for _ in range(rnd.randint(3, 6))) for _ in range(500)]
    out = [" ".join(rnd.choice(prose) for _ in range(200)) for _ in range(40)]
    out += [f'é {t[:50]} password = "{some("0123456789abcdef", 18)}" {t[50:90]} AKIA{some("ABCDEFGHIJ23456", 16)} {some("0123456789abcdef", 40)} 漢字 {some(b64, 40)}' for t in out[:12]]
    out += ["password=token:abcdefghij", "PassWord: 'a.b=c/d-e+f", "api_key=short apikey=longenough1", "token==" + "x" * 9, "secretsecret=12345678AKIA" + "Z" * 12, "AKIAAKIA" + "Q" * 20 + "SECRET=12345678", "ſecret=abcdefgh12", "toKen=abcdefgh12"]
    out += ["a" * 31, "a" * 32, "password=" + "0" * 40, "token=" + some(b64, 30) + " " + "f0" * 16, "passwd  :  \"" + some(b64, 9), "x" + some("0123456789", 16) + "y", "4111111111111111", "the_quick_brown_fox_jumps_over", "1/2/3/4/5/6/7/8/9/10"]
    out += ["token=abcdefgh " * 400, some(b64, 3000), (some("0123456789abcdef", 33) + "\n") * 300, None, "", " ", "\U0001f600 token=abcdefgh\U0001f600secret:12345678"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k if k != 5 else None, t, "f", k) for k, t in enumerate(texts())], "doc_id long, text string, found string, base int")


def test_spans(docs):
    labelled = secrets.samples(docs)
    model, rows = secrets.train(labelled), labelled.collect()
    got = {r.spans if r.doc_id is None else r.doc_id: r for r in secrets.digests(secrets.scan(docs, model)).collect()}
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789+/_-="
    count = {(k, a, b): 0 for k in (0, 1) for a in alphabet + "." for b in alphabet + "."}
    for r in rows:
        v = r.value[:256].lower()
        for a, b in zip(v, v[1:], strict=False):
            count[r.label, a, b] += 1
    row = {(k, a): sum(count[k, a, b] for b in alphabet + ".") for k in (0, 1) for a in alphabet + "."}

    def ratio(v):
        v, p = v.lower(), lambda k, a, b: math.log((count[k, a, b] + 0.5) / (row[k, a] + 41 * 0.5))
        return sum(p(1, a, b) - p(0, a, b) for a, b in zip(v, v[1:], strict=False) if a.isalnum() and b.isalnum())

    added = 0
    for k, text in enumerate(texts()):
        text, r = text or "", got[k] if k != 5 else got[""]
        known = base(text)
        more = [(m.start(), 3, "markov", m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", rest(text, known)) if re.search("[A-Za-z]", m[0])]
        near = [x for x in more if abs(ratio(text[x[0] : x[3]]) - secrets.THRESHOLD) < 0.02]
        assert not near, "too close to the threshold to compare"
        more = [x for x in more if ratio(text[x[0] : x[3]]) >= secrets.THRESHOLD]
        added += len(more)
        said = lambda a: ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in a)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == j for x in known) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(said(known).encode()).hexdigest() and r.spans == said(sorted(known + more)) and r.n_markov == len(more)
    assert added >= 13


def test_samples_are_labelled(spark, docs):
    rows = secrets.samples(docs).collect()
    ones, zeros = {r.value for r in rows if r.label}, {r.value for r in rows if not r.label}
    digest = hashlib.sha256(b"7").hexdigest()
    assert digest in ones and base64.b64encode(bytes.fromhex(digest)).decode().rstrip("=") in ones
    assert "internationalization" in zeros and "longenough1" in ones and not any(z.isdigit() for z in zeros) and len(rows) == len({(r.value, r.label) for r in rows})


def test_without_training_nothing_is_added(spark):
    docs = spark.createDataFrame([(1, "Zk9QpLm3Zt7RwXy4 " * 3 + "token=abcdefgh")], "doc_id long, text string")
    empty = secrets.train(spark.createDataFrame([], "value string, label int"))
    assert set(empty) == {0.0} and secrets.digests(secrets.scan(docs, empty)).first().spans == "assign:51:65"
    assert secrets.scan(docs.limit(0)).count() == 0


def test_main_path_stays_on_the_jvm(docs):
    plan = secrets.digests(secrets.scan(docs, [0.0] * 6400))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Join" not in plan and "Exchange" not in plan
