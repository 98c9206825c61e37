"""Entities that few characters announce."""

from basewright.llm import pii

LONE = [
    ("secret", "sk-abcdefghijKLMNOPqrst"), ("secret", "ghp_abcdefghijKLMNOPqrst"), ("secret", "xoxb-abcdefghijKLMNOPqrst"), ("secret", "abcdef" * 6), ("secret", "FEDCBA" * 6),
    ("phone", "٠١٧-٥٥٥-٧٧١٣"), ("ssn", "१२३-४५-६७८९"),
]


def test_entities_without_ascii_digits(spark):
    """Nothing else in the text speaks for an entity."""
    rows = [(i, f"my key is {x} please") for i, (_, x) in enumerate(LONE)]
    out = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (kind, x) in enumerate(LONE):
        assert (out[i].n_entities, out[i].kinds) == (1, f"{kind}=1") and x not in out[i].text and out[i].text.startswith("my key is ") and out[i].text.endswith(" please")


def test_family_names_of_any_letters(spark):
    names = ["Anna Müller", "Mary Smith-Jones", "John O'Brien", "Peter McDonald", "Елена Ёлкина", "Eva Łoś", "Paul BROWN", "Clara Ne\u0301mec"]
    rows = [(i, f"so {x}, and {x}'s too") for i, x in enumerate(names)] + [(90, "Mary went home, John Smith-like")]
    out = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate(names):
        new = out[i].text[3:].split(",")[0]
        assert out[i].text == f"so {new}, and {new}'s too" and out[i].kinds == "name=2" and not set(x.split(" ")) & set(new.split(" "))
        assert all((a in "-'") == (b in "-'") and a.isupper() == b.isupper() for a, b in zip(new.split(" ")[1], x.split(" ")[1]))
    assert out[90].kinds == "name=1" and out[90].text.startswith("Mary went home, ") and out[90].text.endswith("-like")
    assert pii.dressed("name", "Mary Brown", pii.surrogate("name", "mary brown", 0)).istitle()


def surrogates_of(spark, rows):
    return {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_used_up_formats_grow(spark):
    """All one-letter addresses of a provider and all short addresses of two nets: no draw of their own length is free."""
    mails = [f"{chr(97 + i)}@gmail.com" for i in range(26)]
    ips = [f"{a}.{b}.{c}.{d}" for a in range(10) for b in range(10) for c in range(10) for d in range(10)]
    out = surrogates_of(spark, [(0, " ; ".join(mails)), *((1 + i, " ; ".join(ips[1000 * i : 1000 * i + 1000])) for i in range(10))])
    new = out[0].text.split(" ; ")
    assert len(set(new)) == 26 and not set(new) & set(mails) and all(x.endswith("@gmail.com") for x in new)
    other = [x for i in range(10) for x in out[1 + i].text.split(" ; ")]
    assert len(set(other)) == 10_000 and not set(other) & set(ips) and all(0 <= int(o) < 256 for x in other for o in x.split("."))


def test_late_draws_are_longer():
    for kind, form in (("card", "4111111111111111"), ("ssn", "123456789"), ("phone", "0175557713"), ("ip", "1.2.3.4"), ("name", "mary brown"), ("mail", "a@x.org"), ("secret", "ab" * 20), ("name", "νίκος λάμπρου")):
        assert len(pii.surrogate(kind, form, 12)) > len(pii.surrogate(kind, form, 0)) and pii.surrogate(kind, form, 12) == pii.surrogate(kind, form, 12)
    assert pii.dressed("ssn", "123-45-6789", "98765432100") == "987-65-432100"


def test_personal_domains_go_and_stay_equal(spark):
    out = surrogates_of(spark, [(1, "john@johnsmith.com"), (2, "JANE@JohnSmith.com, x@a.johnsmith.co.uk")])
    a, b = out[1].text, out[2].text.split(", ")[0]
    assert "smith" not in (out[1].text + out[2].text).lower() and a.split("@")[1] == b.split("@")[1].lower() and out[2].text.endswith(".co.uk")


def test_names_by_context(spark):
    text = "Priya Sharma met Wei Zhang and Mohammed Ali. Later Dr. Kemal Öztürk, Ada Obi and some friends left New York."
    out = surrogates_of(spark, [(1, text), (2, "then Wei Zhang said so; the Grand Hotel said nothing of New York"), (3, "Νίκος Λάμπρου said it")])
    for x in ("Priya", "Sharma", "Wei", "Zhang", "Mohammed", "Ali.", "Kemal", "Öztürk", "Ada", "Obi"):
        assert x not in out[1].text
    assert out[1].kinds == "name=5" and out[1].text.endswith(" and some friends left New York.")
    wei = out[1].text.split(" met ")[1].split(" and ")[0]
    assert out[2].text.startswith(f"then {wei} said so") and out[2].text.endswith("New York") and "Νίκος" not in out[3].text


def test_distinct_and_coreferent_by_brute_force(spark):
    import itertools
    import random
    rng = random.Random(5)
    pool = [f"{a}{b}@{c}.{d}" for a, b, c, d in itertools.product("abc", ["", "1"], ["x", "gmail"], ["com", "de"])] + [f"10.0.0.{i}" for i in range(256)]
    pool += [f"{g} {f}" for g in ("Mary", "John", "Anna") for f in ("Fox", "Lee", "Ng")] + [f"{i:03}-55-{i:04}" for i in range(40)]
    rows = [(None if i % 7 == 0 else i, " ; ".join(rng.choices(pool, k=12))) for i in range(200)]
    out = pii.with_surrogates(spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, spans long")).collect()
    old, new = {}, {}
    for (_, t), r in zip(sorted(rows, key=lambda r: (r[0] or -1)), sorted(out, key=lambda r: (r.doc_id or -1)), strict=True):
        if r.doc_id is None:
            continue
        for a, b in zip(t.split(" ; "), r.text.split(" ; "), strict=True):
            assert old.setdefault(a, b) == b and new.setdefault(b, a) == a and b not in pool
    lone = [x for r in out if r.doc_id is None for x in r.text.split(" ; ")]
    assert lone and set(lone) <= set(new) | set(lone) and not set(lone) & set(pool)
    assert all(old.get(new.get(x)) == x for x in lone if x in new)


def test_mentions_take_their_part(spark):
    """The given or the family name alone, with or without a title, before and after the whole name."""
    rows = [
        (1, "John Smith met Anna Brown. Smith said hello to Anna. Mr. Smith's dog and SMITH, Anna-like, Smithson."),
        (2, "Mary Smith met John Smith; later Smith left. Mary stayed."), (3, "Smith and Anna are words here."), (4, "Dr. O'Brien saw Mr Lee and Prof. van der Berg"),
        (5, "Maria de la Cruz called. Then Cruz wrote."), (6, "MARIA LOPEZ and Anna Brown met; Lopez spoke."),
    ]
    out = {i: r.text for i, r in surrogates_of(spark, rows).items()}
    for x in ("John", "Smith ", "Smith'", "SMITH", "Brown", "Anna.", "to Anna"):
        assert x not in out[1]
    john, anna = out[1].split(". ")[0].split(" met ")
    family, given = john.split(" ")[1], anna.split(" ")[0]
    assert f". {family} said hello to {given}. Mr. {family}'s dog and {family.upper()}, Anna-like, Smithson." in out[1]
    first, second = out[2].split(";")[0].split(" met ")
    assert out[2].endswith(f"; later {second.split(' ')[1]} left. {first.split(' ')[0]} stayed.")
    assert out[3] == rows[2][1]
    assert not any(x in out[4] for x in ("Brien", "Lee", "Berg")) and out[4].startswith("Dr. ") and " saw Mr " in out[4] and "Prof. van der " in out[4] and "'" in out[4].split(" ")[1]
    assert "Cruz" not in out[5] and " de la " in out[5] and out[5].split(" called")[0].split(" ")[-1] == out[5].split("Then ")[1].split(" ")[0]
    whole = out[6].split(" and ")[0]
    assert whole.isupper() and out[6].split("; ")[1] == f"{whole.split(' ')[1].capitalize()} spoke."
    assert "Lopez" not in out[6] and "LOPEZ" not in out[6]


def test_long_words_before_a_verb_stay_whole(spark):
    long = "A" + "b" * 300
    rows = [(1, f"so Priya {long} said it"), (2, f"{'x' * 500}Priya said it")]
    out = surrogates_of(spark, rows)
    assert out[1].kinds == "name=1" and "Priya" not in out[1].text and long not in out[1].text and out[1].text.endswith(" said it")
    assert (out[2].n_entities, out[2].text) == (0, rows[1][1])


def test_account_and_network_numbers(spark):
    values = {
        "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819"], "ip6": ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "2001:DB8::1"],
        "phone": ["030 1234567", "0171/5551234", "(040) 123456"],
    }
    rows = [(10 * k + i, f"at {x} now, at 12:30:45 and 3.141 592653") for k, xs in enumerate(values.values()) for i, x in enumerate(xs)]
    out = surrogates_of(spark, rows)
    for k, (kind, xs) in enumerate(values.items()):
        for i, x in enumerate(xs):
            r = out[10 * k + i]
            new = r.text.removeprefix("at ").removesuffix(" now, at 12:30:45 and 3.141 592653")
            assert r.kinds == f"{kind}=1" and new != x and [c.isalnum() or c for c in new] == [c.isalnum() or c for c in x], (x, r.text)
            if kind == "iban":
                plain = new.replace(" ", "")
                assert plain[:2] == x[:2] and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_very_long_texts(spark):
    text = "Anna Brown said so. " * 5000 + "w" * 300_000 + " mail a.b@example.org " + "Brown " * 2000
    out = surrogates_of(spark, [(1, text)])[1]
    assert out.n_entities == 7001 and "Brown" not in out.text and len(set(out.text.split("said")[k].split(". ")[-1] for k in range(1, 4999))) == 1
