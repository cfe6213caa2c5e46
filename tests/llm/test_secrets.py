import math
import random
import re

from frames import docs
from meterlake.llm import secrets
from meterlake.llm.queries import op9_secrets

BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain(text):
    keep = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    order = list(BASE)
    spans = [(m.start(), order.index(k), m.end()) for k, p in BASE.items() for m in p.finditer(text) if keep[k](m)]
    return [(a, order[k], b) for a, k, b in sorted(spans)]


def base(text):
    return [s for s in secrets.scan_text(text) if s[1] != "guess"]


def test_patterns_match_the_plain_definition():
    rng = random.Random(11)
    parts = ["password", "PassWD", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "Z9Q8", "0123456789abcdef"]
    parts += ["\n", "é", "ſecret", "toKen", "x", "deadbeef" * 4, "-", "/+="]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert base(text) == plain(text), repr(text)


def test_patterns_on_whole_documents(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op9_secrets(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = r.spans.split(",") if r.spans else []
        expected = plain(texts[r.doc_id])
        assert [s for s in spans if not s.startswith("guess")] == [f"{k}:{a}:{b}" for a, k, b in expected]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in expected) for x in BASE)


def test_guess_costs_follow_the_strength():
    weak = ["password", "P4ssword", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "2019-05-04", "letmein2020", "abcdefghijkl", "monkeymonkey"]
    strong = ["xK9#mQ2$vL7p", "tr8vZq1nWc0y", "gh7Tq-92kLmZ-0pQx"]
    assert max(map(secrets.guess_cost, weak)) < 9 < min(map(secrets.guess_cost, strong))
    assert secrets.guess_cost("") == 0
    assert secrets.guess_cost("qwerty" + "j7#Kz!") < secrets.guess_cost("qwvrtx" + "j7#Kz!")
    assert secrets.guess_cost("a" * 5000) < 9 < secrets.guess_cost("k3V" * 1 + "9xQz71Lw" * 40)


def test_values_in_credential_context_are_added():
    text = "the login: xK9#mQ2$vL7p and pwd is monkey2019. password = hunter22hunter22"
    spans = [(text[a:b], k) for a, k, b in secrets.scan_text(text)]
    assert spans == [("xK9#mQ2$vL7p", "guess"), ("password = hunter22hunter22", "assign")]


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None), (1, None), (None, "token: abcdefgh12"), (3, "")]
    found = secrets.scan(docs(spark, rows).selectExpr("*", "1 as found")).collect()
    assert sorted((r.doc_id or 0, len(r.found)) for r in found) == [(0, 1), (1, 0), (1, 0), (3, 0)]
    assert secrets.scan(docs(spark, [])).collect() == []


def test_ordinary_sentences_after_credential_words(spark):
    prose = ["The password is invalid.", "login: mandatory", "the pwd is temporarily unavailable", "auth: optional", "passphrase is gezwungenermaßen"]
    known = "it is mandatory that services be temporarily closed, gezwungenermaßen"
    secret = "the password is qwvrtxkzplm"
    rows = [*enumerate([*prose, known, secret, secret])]
    found = {r.doc_id: r.found for r in secrets.scan(docs(spark, rows)).collect()}
    assert sorted(k for k, f in found.items() if f) == [len(prose) + 1, len(prose) + 2]
    ranks = {r.word: r["rank"] for r in secrets.corpus_words(docs(spark, rows).select("text")).collect()}
    assert "qwvrtxkzplm" not in ranks and ranks["temporarily"] == ranks["mandatory"] > ranks["the"]


def test_keys_in_camel_case_and_quoted_values():
    for text, value in [
        ('dbPassword = "q7$Kz!9vLm"', "q7$Kz!9vLm"),
        ("clientSecret: 'a,b;c|d<e>f(g)h'", "a,b;c|d<e>f(g)h"),
        ("db2Pwd=q7$Kz!9vLmW", "q7$Kz!9vLmW"),
        ('{"apiLogin": "x\\"7 k{Q]2z#w"}', 'x\\"7 k{Q]2z#w'),
        ('pwd = "q7$Kz!9vLm', "q7$Kz!9vLm"),
    ]:
        assert [(text[a:b], k) for a, k, b in secrets.scan_text(text)] == [(value, "guess")], text
    assert secrets.scan_text("compass: q7$Kz!9vLm") == []


def test_spans_of_a_long_text_with_many_secrets():
    """Two megabytes of settings take seconds, since a value is looked up among the base spans."""
    line = 'password = "q7$Kz!9vLm#2xW"\ntoken = abcdefgh12345678\nhash: 0123456789abcdef0123456789abcdef\n'
    found = secrets.scan_text(line * 20_000)
    assert len(found) == 60_000 and found[:3] == sorted(secrets.scan_text(line)) and {k for _, k, _ in found} == {"assign", "hex", "guess"}


def test_merged_spans():
    assert secrets.merged([(5, 2, 9), (1, 0, 3), (2, 1, 4), (9, 0, 12)]) == [(1, 4), (5, 12)]
    assert secrets.merged([]) == []


def costs_of_all_cuts(value):
    """The cheapest of all segmentations, tried one by one."""
    spans = [(i, j, c) for i, j, c in secrets._matches(value, secrets.RANK)]
    spans += [(i, j, sum(math.log10(secrets._alphabet(c)) for c in value[i:j])) for i in range(len(value)) for j in range(i + 1, len(value) + 1)]

    def cheapest(at):
        return 0.0 if at == len(value) else min(secrets.PART + c + cheapest(j) for i, j, c in spans if i == at)

    return cheapest(0)


def test_guess_costs_are_the_least_of_all_segmentations():
    rng = random.Random(6)
    for value in ["password", "qwerty12", "aaaa1999", "Dragon!", "2024-01", "abcabc", "p4ssw0rd", *("".join(rng.choice("ab1Qq9w!e") for _ in range(7)) for _ in range(40))]:
        assert abs(secrets.guess_cost(value) - costs_of_all_cuts(value)) < 1e-9


def test_what_is_looked_up_can_all_be_found():
    """No span that the costs look up and that is a word may miss among the candidates."""
    class Asked(dict):
        def get(self, key, default=None):
            asked.add(key)
            return default

    rng = random.Random(8)
    for _ in range(200):
        value, asked = "".join(rng.choices("abZé1_4@ßİ5 $x", k=rng.randint(1, 40))), set()
        secrets.guess_cost(value, Asked())
        assert {a for a in asked if secrets.WORD.fullmatch(a)} <= set(secrets.may_be_words(value)), value


def test_every_word_of_the_texts_counts(spark, monkeypatch):
    """The whole scan gives what one dictionary of all words gives, however rare the words and small the batches."""
    monkeypatch.setattr(secrets, "CHUNK", 7)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 12))) for _ in range(300)]
    rows = [(k, f"{' '.join(rng.choices(words, k=9))} login: {rng.choice(words)}{rng.choice(['', '-', '7'])}{rng.choice(words)} "
                f"pwd = {''.join(rng.choices('abcdefghijk23', k=11))}, token=abcd1234efgh") for k in range(150)]  # fmt: skip
    table = docs(spark, rows)
    ranks = {r.word: r["rank"] for r in secrets.corpus_words(table.select("text")).collect()} | secrets.RANK
    found = {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.found] for r in secrets.scan(table).collect()}
    assert found == {k: secrets.scan_text(t, ranks) for k, t in rows}
    assert any(secrets.scan_text(t, ranks) != secrets.scan_text(t) for _, t in rows)
