import re

from galleryloom.llm import secrets
from galleryloom.llm.common import table

PLANTED = r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}"


def test_query_finds_planted_secrets(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r for r in secrets.op7_secret_scan(spark, sf).collect()}
    assert len(got) == len(texts)
    wrong = [i for i, t in texts.items() if set(filter(None, got[i].secrets.split("\n"))) != set(re.findall(PLANTED, t))]
    assert not wrong, [(got[i], re.findall(PLANTED, texts[i])) for i in wrong[:3]]


def test_candidates_equal_plain_reading(spark):
    language = secrets.Language(["the", "word"], ["th"])
    text = "x password: 'abc12345' (api_key=ZZ9zz9ZZ9) see path/to/file1.txt, secret = \"no-digits-here\" short1 plainlongword 12345678"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(secrets.candidates(df.t, language).alias("c")).first().c
    assert [(c.value, c.before, c.assigned) for c in got] == [
        ("abc12345", "password", 1.0), ("ZZ9zz9ZZ9", "api_key", 1.0), ("path/to/file1.txt", "see", 0.0),
        ("no-digits-here", "secret", 1.0), ("12345678", "plainlongword", 0.0),
    ]


def test_tree_text():
    text = "DecisionTree\n  If (feature 3 <= 0.5)\n   Predict: 0.0\n  Else (feature 3 > 0.5)\n   If (feature 0 <= 2.25)\n    Predict: 1.0\n   Else (feature 0 > 2.25)\n    Predict: 0.0\n"
    assert secrets.parse_tree(text) == (3, 0.5, 0.0, (0, 2.25, 1.0, 0.0))


def test_edges(spark):
    key = "AKIA" + "ABCD1234" * 2
    rows = [(1, None), (2, ""), (3, "  \n "), (4, f"use {key} and {key}."), (4, f"use {key} and {key}."), (None, "mail a.b1@example.org now"), (5, ("filler text " * 20_000) + key)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, findings string, value string")
    language = secrets.Language.learn(df)
    forest = secrets.Forest.fit(secrets.labelled_findings(df, language))
    for f in (forest, None):
        out = secrets.redact(df, language, f)
        assert out.columns == df.columns
        got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=repr)
        want = [(i or 0, t.replace(key, "[SECRET]") if t else t) for i, t in rows]
        assert got == sorted(want, key=repr)
    empty = df.limit(0)
    assert secrets.Forest.fit(secrets.labelled_findings(empty, secrets.Language.learn(empty))) is None
    assert secrets.with_secrets(empty, language, forest).count() == 0


def test_every_name_and_value_of_a_run(spark):
    key = "0123456789abcdef0123456789abcdef01234567"
    language = secrets.Language(["the", "word"], ["th"])
    forms = {
        '{"user":"bob","password":"abc123XYZ789qq"}': ("abc123XYZ789qq", "password", 1.0), f'{{"id":1,"token":"{key}"}}': (key, "token", 1.0),
        f'f(x,token="{key}")': (key, "token", 1.0), f"see(token:{key})": (key, "token", 1.0), f'<a><b>token="{key}': (key, "token", 1.0),
        f"https://h.example/p?id=1&token={key}&x=2": (key, "token", 1.0), f"https://h.example/p?token={key}": (key, "token", 1.0),
        f'"1","bob","{key}"': (key, "bob", 0.0), f"1,bob,{key},x": (key, "bob", 0.0), f"a=1;token={key};b=2": (key, "token", 1.0),
        "{'password':'abc123XYZ789qq'}": ("abc123XYZ789qq", "password", 1.0), "'password' => 'abc123XYZ789qq'": ("abc123XYZ789qq", "password", 1.0),
        "password=ab,cd&1234": ("ab,cd&1234", "password", 1.0), '{"password":1234567890,"a":1}': ("1234567890", "password", 1.0),
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    for row in df.select("t", secrets.candidates(df.t, language).alias("c")).collect():
        found = [(c.value, c.before, c.assigned) for c in row.c]
        assert forms[row.t] in found, (row.t, found)


def test_credentials_are_not_taught_as_harmless(spark):
    language = secrets.Language(["docs", "english", "page"], ["en", "ng", "gl", "li", "is", "sh", "do", "oc", "cs", "pa", "ag", "ge"])
    forms = {
        "aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": 1.0, "password = Letmeinplease123": 1.0, "secret: docs/english/page12": None,
        "token: 20240101123456": None, "password=v1.2.3.4.5.6.7": None, "see wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY": None,
        "see docs/english/page12": 0.0, "room Letmeinplease123": 0.0, "mail a.b123@example.org": 0.0,
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    c = secrets.candidates(df.t, language)[0]
    assert {r.t: r.label for r in df.select("t", secrets.shape_label(c).alias("label")).collect()} == forms


def test_forest_judges_assigned_keys_with_slashes(spark, sf):
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents").select("doc_id", "text")
    key, word = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "Letmeinplease123"
    planted = spark.createDataFrame([(-1, f"aws_secret_access_key = {key} is set"), (-2, f"password = {word} is set")], "doc_id long, text string")
    docs = docs.union(planted)
    found = secrets.with_secrets(planted, *secrets.learn(docs)).collect()
    assert {f.value for r in found for f in r.findings if f.score >= secrets.THRESHOLD} == {key, word}


def test_tokens_without_digits_behind_a_sign(spark):
    language = secrets.Language(["the", "word"], ["th"])
    forms = {
        "password = correcthorsebattery": "correcthorsebattery", 'token = "AbCdEfGhIjKlMnOp"': "AbCdEfGhIjKlMnOp", "password: correcthorsebattery": "correcthorsebattery",
        "Authorization: Bearer AbCdEfGhIjKlMnOp": "AbCdEfGhIjKlMnOp", '{"api_key" : "AbCdEfGhIjKlMnOp"}': "AbCdEfGhIjKlMnOp", '{"secret":"no-digits-here"}': "no-digits-here",
        "x=1&password=correcthorsebattery": "correcthorsebattery", "word = correcthorsebattery": None, "the secret correcthorsebattery": None, "the1,correcthorsebattery": "the1,correcthorsebattery",
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    got = {r.t: [c.value for c in r.c] for r in df.select("t", secrets.candidates(df.t, language).alias("c")).collect()}
    assert got == {t: [v] if v else [] for t, v in forms.items()}


def test_words_come_from_all_texts(spark):
    texts = [(f"alpha beta {'gamma' if i % 2 else 'delta'} w{i}",) for i in range(5000)] + [(" ".join(["rare"] * 50),)] * 200
    df = spark.createDataFrame(texts, "text string")
    language = secrets.Language.learn(df)
    # Counts over all texts: rare 10,000, alpha and beta 5,000, gamma and delta 2,500 each; the least pairs are those of gamma and delta.
    assert set(language.words.split("|")) == {"rare", "alpha", "beta", "gamma", "delta"}
    split = spark.createDataFrame([(f"{'x' * 3}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} " * (2 if i < 300 else 1),) for i in range(676)] * 4, "text string")
    kept = set(secrets.Language.learn(split).words.split("|"))
    assert kept == {f"xxx{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)}
