import re

import pytest

from hanga.llm import pii as P
from llm_fixtures import hard_rows, make_docs, make_labels  # noqa: F401

KEY = b"k"


def kinds(text):
    return [(text[a:b], k) for a, b, k, _ in P.detect(text)]


def test_detection():
    text = ('Mail jo.doe+x@mail3.example.com, call +1 (013) 555-9871 or (415) 555-2671. IP 10.1.2.3, not 1.2.3.4.5 '
            'or 300.1.1.1; card 4111 1111 1111 1111; ssn 123-45-6789; id 9592442921002355. '
            'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d" IBAN DE89 3704 0044 0532 0130 00. '
            'Mrs. Jane Roe met Herr Müller and José García; version 2.0 of 2024')
    assert kinds(text) == [
        ("jo.doe+x@mail3.example.com", "email"), ("+1 (013) 555-9871", "phone"), ("(415) 555-2671", "phone"),
        ("10.1.2.3", "ipv4"), ("4111 1111 1111 1111", "account"), ("123-45-6789", "ssn"),
        ("9592442921002355", "account"), ("ffc3105535f423f352535e4ac53b5fefe076ac6d", "secret"),
        ("DE89 3704 0044 0532 0130 00", "iban"), ("Jane Roe", "name"), ("Müller", "name"), ("José García", "name")]
    assert P.detect(None) == P.detect("") == P.detect("plain text, 12 apples & 3.5 pears") == []


def replaced(spark, make_docs, rows, **kw):
    docs = make_docs(rows, **kw)
    got = P.replace_pii(docs, key="secret key")
    assert got.columns[:len(docs.columns)] == [c for c in docs.columns if c != "pii_spans"] + ["pii_spans"] \
        or got.columns == docs.columns + ["pii_spans"]
    return got.collect()


def test_format_consistency_and_coreference(spark, make_docs):
    rows = [(1, "call +1 (013) 555-9871 or +1 013 555 9871, mail A.B@X.COM"), (2, "mail a.b@x.com, c.d@x.com"),
            (3, "card 4111 1111 1111 1111 or 4111111111111111; 1234567890123456"),
            (4, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"'),
            (5, "IBAN DE89370400440532013000 and 192.168.3.4 and 8.8.8.8"),
            (6, "Mr Jan Kok and Mrs Eva Kok, господин Иван Петров"), (7, "MR JAN KOK, Mr Jan Kok")]
    by = {r["doc_id"]: r["text"] for r in replaced(spark, make_docs, rows)}
    a, b = re.fullmatch(r"call \+1 \((\d{3}\) \d{3}-\d{4}) or \+1 (\d{3} \d{3} \d{4}), mail .*", by[1]).groups()
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "0135559871"
    upper = by[1].split("mail ")[1]
    first, second = by[2][5:].split(", ")
    assert upper == first.upper() and first.split("@")[1] == second.split("@")[1] and first != second
    spaced, plain, other = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}); (\d{16})", by[3]).groups()
    assert spaced.replace(" ", "") == plain and P.luhn_ok(plain) and other != "1234567890123456"
    up, low = re.findall(r'"([0-9A-Fa-f]{40})"', by[4])
    assert up == low.upper() and low != "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    iban, private, public = re.fullmatch(r"IBAN (DE\d{20}) and (192\.168\.\S+) and (\S+)", by[5]).groups()
    assert P.iban_ok(iban) and iban != "DE89370400440532013000" and public != "8.8.8.8"
    m, f, ru = re.fullmatch(r"Mr (\w+ \w+) and Mrs (\w+ \w+), господин (\w+ \w+)", by[6]).groups()
    assert m.split()[0] in P.GIVEN[("latin", "m")] and f.split()[0] in P.GIVEN[("latin", "f")]
    assert ru.split()[0] in P.GIVEN[("cyrillic", "m")] and ru.endswith("ов")
    assert by[7].endswith(f"Mr {m}")


def test_everything_detected_is_gone_and_spans_point_at_surrogates(spark, make_docs, hard_rows):
    rows = hard_rows + [(30 + i, f"user{i % 7}@mail.example.com 10.0.0.{i} +1 (0{i:02d}) 555-00{i:02d} " * 3)
                        for i in range(40)]
    got = replaced(spark, make_docs, rows, clash=True)
    assert len(got) == len(rows)
    pairs = {}
    for (i, old), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["text"]))), strict=True):
        del i, old, r
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] >= 30}
    originals = {old[a:b] for i, old in rows if i is not None and i >= 30 for a, b, _, _ in P.detect(old)}
    for i, old in rows[len(hard_rows):]:
        r = by[i]
        found = P.detect(old)
        assert [s["kind"] for s in r["pii_spans"]] == [k for _, _, k, _ in found]
        for (a, b, k, _), s in zip(found, r["pii_spans"], strict=True):
            new = r["text"][s["start"]:s["end"]]
            assert new not in originals
            assert pairs.setdefault((k, old[a:b]), new) == new           # coreference
    assert len(set(pairs.values())) == len(pairs)                          # distinctness
    for r in got:
        if r["doc_id"] is None or r["doc_id"] < 30:
            assert (r["doc_id"], r["text"]) in hard_rows and r["pii_spans"] == []
    assert P.replace_pii(make_docs([]), "k").count() == 0


def test_clashes_are_drawn_again(spark, make_docs, monkeypatch):
    """A surrogate space so small that clashes are certain."""
    def tiny(kind, norm, detail, attempt, key):
        return f"192.0.2.{P._Stream(key, kind, norm, attempt).below(60)}"
    monkeypatch.setattr(P, "surrogate", tiny)
    ips = [f"192.0.2.{i}" for i in range(5)] + [f"198.51.100.{i}" for i in range(20)]
    found = P.mentions(make_docs([(i, f"at {ip} now") for i, ip in enumerate(ips)]))
    got = P.assign(found, KEY).collect()
    values = [r["value"] for r in got]
    assert len(got) == 25 == len(set(values)) and not set(values) & set(ips)
    assert any(r["attempt"] > 0 for r in got)


def test_exceptions_reach_the_rewriting(spark, make_docs, monkeypatch):
    real = P.surrogate

    def clash_first(kind, norm, detail, attempt, key):
        return "192.0.2.77" if attempt == 0 else real(kind, norm, detail, attempt, key)
    monkeypatch.setattr(P, "surrogate", clash_first)
    rows = [(i, f"at 10.9.8.{i} and 10.9.8.{i}") for i in range(5)] + [(None, "at 10.9.8.1")]
    got = {r["doc_id"]: r["text"].split()[1::2] for r in P.replace_pii(make_docs(rows), key="z").collect()}
    assert all(a == b for k, (a, *rest) in got.items() for b in rest) and got[None] == [got[1][0]]
    assert len({v[0] for k, v in got.items() if k is not None}) == 5


def test_surrogates_depend_on_the_key():
    a = P.surrogate("phone", "+15551234567", "", 0, b"a")
    assert a == P.surrogate("phone", "+15551234567", "", 0, b"a") != P.surrogate("phone", "+15551234567", "", 0, b"b")
    assert a.startswith("+1") and len(a) == 12


def test_whole_names_are_taken():
    def names(text):
        return [m for m, k in kinds(text) if k == "name"]
    assert names("Mr Juan Carlos Garcia Lopez came") == ["Juan Carlos Garcia Lopez"]
    assert names("Maria Garcia Lopez and Anna Smith-Jones") == ["Maria Garcia Lopez", "Anna Smith-Jones"]
    assert names("Mr O'Brien, Mrs D’Arcy-O'Neill; Jean-Pierre Dupont.") == \
        ["O'Brien", "D’Arcy-O'Neill", "Jean-Pierre Dupont"]
    assert names("Mr Smith's car") == ["Smith"]
    assert names("Анна Петрова-Водкина Иванова пришла") == ["Анна Петрова-Водкина Иванова"]
    assert names("Dr 김철수 교수는 오늘 학교에 갔다") == ["김철수 교수는 오늘"]     # at most three without case


def test_surnames_agree_with_full_names(spark, make_docs):
    rows = [(1, "John Smith met Mary Smith. Mr Smith left, Mrs SMITH stayed."),
            (2, "Dr Smith, Mr Juan Carlos Garcia Lopez, Señor Lopez"), (3, "господин Иван Петров, господин Петров")]
    # more people of one surname than given names
    rows += [(10 + i, f"Mr Kof{chr(97 + i % 26)}{'xy'[i // 26]}n Smith spoke") for i in range(52)]
    by = {r["doc_id"]: r["text"] for r in replaced(spark, make_docs, rows)}
    john, mary, one, two = re.fullmatch(r"(\w+ \w+) met (\w+ \w+)\. Mr (\w+) left, Mrs (\w+) stayed\.", by[1]).groups()
    assert john.split()[1] == mary.split()[1] == one == two.capitalize() and john != mary and one != "Smith"
    doctor, full, last = re.fullmatch(r"Dr (\w+), Mr ([\w ]+), Señor (\w+)", by[2]).groups()
    assert doctor == one and full.split()[-1] == last and len(full.split()) == 4
    a, b = re.fullmatch(r"господин \w+ (\w+), господин (\w+)", by[3]).groups()
    assert a == b and a.endswith("ов")
    people = [re.fullmatch(r"Mr (\w+ \w+) spoke", by[10 + i]).group(1) for i in range(52)]
    assert len(set(people)) == 52 and {p.split()[1] for p in people} == {one}
    assert not {p.split()[0] for p in people} & {t.split()[1] for _, t in rows[3:]}


def test_full_surrogate_spaces_grow(spark, make_docs, monkeypatch):
    """More surnames than words of four syllables, more short numbers than
    digits, secrets without a letter."""
    monkeypatch.setitem(P.SYLLABLES, "latin", ["ba", "co"])
    surnames = [f"Zor{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = [(i, f"Mr {s} called") for i, s in enumerate(surnames)] + [(100, "password: ________ ok"),
                                                                      (101, "password: --------")]
    by = {r["doc_id"]: r["text"] for r in replaced(spark, make_docs, rows)}
    new = {by[i].split()[1] for i in range(len(surnames))}
    assert len(new) == len(surnames) and not new & set(surnames)
    assert "____" not in by[100] and "----" not in by[101]


def test_later_draws_leave_small_ranges():
    def values(kind, norm, attempts):
        return {P.surrogate(kind, norm, "", a, KEY) for a in attempts}
    for norm in ("192.168.3.4", "169.254.3.4"):
        assert all(v.startswith(norm[:8]) for v in values("ipv4", norm, range(8)))
        assert all(v.startswith("10.") for v in values("ipv4", norm, range(8, 16)))
        assert all(240 <= int(v.split(".")[0]) <= 255 for v in values("ipv4", norm, range(16, 100)))
    assert len(P.surrogate("phone", "+491234", "", 0, KEY)) == 7 < len(P.surrogate("phone", "+491234", "", 8, KEY))
    longer = P.surrogate("phone", "+491234", "", 9, KEY)
    assert P.normal_form("phone", P.render("phone", "+49 1 2 34", "+491234", longer)) == longer
    assert P.luhn_ok(P.surrogate("account", "4111111111111111", "", 20, KEY))


def test_a_key_is_required(make_docs):
    with pytest.raises(TypeError):
        P.replace_pii(make_docs([]))
    with pytest.raises(ValueError):
        P.replace_pii(make_docs([]), "")


def test_surrogates_are_compared_across_kinds(spark, monkeypatch):
    """The first draw of a phone is a real account number in another format, and
    two kinds draw the same digits: both are drawn again."""
    def fake(kind, norm, detail, attempt, key):
        return {0: {"phone": "+15550001111", "ssn": "222334444", "account": "222334444"}[kind]}.get(
            attempt, f"{kind}-{norm}-{attempt}".translate(str.maketrans("-", "x")))

    monkeypatch.setattr(P, "surrogate", fake)
    rows = [("phone", "+4912345", ""), ("account", "15550001111", ""), ("ssn", "111223333", "")]
    found = spark.createDataFrame(rows, "kind string, norm string, detail string")
    got = {r["kind"]: (r["attempt"], r["value"]) for r in P.assign(found, b"k").collect()}
    assert got["phone"][0] == 1 and got["account"] == (0, "222334444") and got["ssn"][0] == 1
