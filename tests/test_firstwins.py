import random

from leadloom.operators.firstwins import first_wins_by_rules

SCHEMA = "seq long, identity_key string, canonical_domain string, normalized_phone string, name_key string, city string, strong boolean, _state string"


def _one_by_one(rows):
    keys, domains, cities, phones, domain_name, phone_name, kept = set(), set(), set(), set(), {}, {}, set()
    for seq, key, domain, phone, name, city, strong, _ in sorted(rows):
        if key and key in keys:
            continue
        if domain and domain in domains and name and domain_name[domain] == name:
            continue
        if phone and phone in phones and name and phone_name.get(phone) == name:
            continue
        if not strong and ((domain and city and (domain, city) in cities) or (phone and phone in phones)):
            continue
        kept.add(seq)
        if key:
            keys.add(key)
        if domain:
            domains.add(domain)
            domain_name.setdefault(domain, name or "")
            if city and not strong:
                cities.add((domain, city))
        if phone:
            phone_name.setdefault(phone, name or "")
            if not strong:
                phones.add(phone)
    return kept


def test_equals_one_by_one(spark):
    rng = random.Random(9)
    for trial in range(3):
        n = 120 + 60 * trial
        some = lambda letter, k, none=0.3: None if rng.random() < none else f"{letter}{rng.randrange(k)}"
        rows = [(i, some("k", n // 2), some("d", 12 + 20 * trial), some("p", 15 + 20 * trial), some("n", 6), some("c", 3), rng.random() < 0.5, "x") for i in rng.sample(range(n * 3), n)]
        got = {r["seq"] for r in first_wins_by_rules(spark.createDataFrame(rows, SCHEMA)).where("duplicate is null").collect()}
        assert got == _one_by_one(rows)


def test_reasons_and_nothing(spark):
    rows = [(1, "a", "d", "p", "n", "c", True, None), (2, "a", None, None, None, None, True, None), (3, "b", "d", None, "n", None, True, None), (4, "c", "d", None, "m", None, True, None), (5, "e", None, "p", "n", None, False, None), (6, "f", None, "p", "z", None, False, None), (7, None, None, None, "", None, None, None)]
    got = {r["seq"]: r["duplicate"] for r in first_wins_by_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: "identity", 3: "domain+name", 4: None, 5: None, 6: "phone", 7: None}
    assert first_wins_by_rules(spark.createDataFrame([], SCHEMA)).collect() == []
