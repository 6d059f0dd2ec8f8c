from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import rows

from ledgerloom.llm import entity_match, names

REC = "record_id long, source string, jurisdiction string, reg_number string, name string, status string, address string, retrieved_at timestamp, lei int"
LEI = "lei string, legal_name string, country string, status string, city string, postcode string, registered_as string, last_update timestamp, name string"
RNG = random.Random(9)
CORES = ["".join(RNG.choice(c) for c in ("BDGKLMNPRSTVZ", "aeiou", "lnrst", "bdgkmpv", "aeiou", "lmnrt", "aio", "ndkrs", "aeu", "lnrs")) for _ in range(60)]


def company_tables(spark):
    rec, lei, want = [], [], []
    for i in range(60):
        core = CORES[i]
        line = ["Foods", "Mining", "Paper"][i % 3]
        rec.append((i, "BRREG", "NO", f"9{i:08d}", f"{core} {line} AS", "active", f"Storgata {i}, {1000 + i} Langby", None, 0))
        if i % 2 == 0:
            rec.append((1000 + i, "BRREG", "NO", f"8{i:08d}", f"{core} {line} Holding AS", "active", f"Storgata {i}, {1000 + i} Langby", None, 0))
            rec.append((2000 + i, "PRH", "FI", f"7{i:08d}", f"{core} {line} Oy", "active", None, None, 0))
        if i % 3:
            typed = core[:3] + core[4:] if i % 4 == 1 else core
            lei.append((f"L{i:03d}", f"{typed.upper()} {line} Aksjeselskap" if i % 2 else f"{line} {typed} AS", ["NO", "Norway", None][i % 3], "ACTIVE", "Langby", str(1000 + i), None, None, "x"))
            want.append((i, f"L{i:03d}"))
    lei.append(("L999", "Unknown Thing Foods AS", "NO", None, None, None, None, None, None))
    lei.append((None, "Borvanika Foods AS", "NO", None, None, None, None, None, None))
    return spark.createDataFrame(rec + rec[:3], REC), spark.createDataFrame(lei + lei[:3], LEI), sorted(want, key=repr)


def test_entities_without_keys(spark):
    rec, lei, want = company_tables(spark)
    got = entity_match.match(rec, lei)
    assert rows(got.select("record_id", "lei")) == want, (set(rows(got.select("record_id", "lei"))) ^ set(want))
    assert got.filter("confidence between 0.5 and 1").count() == len(want)
    assert entity_match.match(rec.filter("false"), lei).count() == 0


def test_mixture_finds_two_groups():
    rng = np.random.default_rng(1)
    cells = np.clip(np.vstack([rng.normal(0.9, 0.05, (200, 3)), rng.normal(0.3, 0.1, (800, 3))]), 0, 1)
    cells[::7, 2] = entity_match.UNKNOWN  # attributes that are not known
    cells[3:200:20, 1] = 0.0  # and some that are wrong
    model = entity_match.fit_mixture(cells, np.ones(1000), np.where(entity_match.start(cells) > 0, 0.95, 0.05))
    odds = entity_match.log_odds(cells, model)
    assert (odds[:200] > 0).mean() > 0.97 and (odds[200:] > 0).mean() < 0.01


def test_rivals_share_a_posterior(spark):
    pairs = spark.createDataFrame([(1, "A", 3.0), (2, "A", 3.0), (3, "B", 5.0), (3, "C", 0.0), (4, "D", 1.0)], "record_id long, lei string, odds double")
    held = {(r.record_id, r.lei): r.held for r in entity_match.compete(pairs).collect()}
    assert abs(held[(1, "A")] - held[(2, "A")]) < 1e-12 and held[(1, "A")] < 0.5 and held[(3, "B")] > 0.9 and held[(3, "C")] < 0.01
    assert abs(held[(4, "D")] - np.exp(1) / (1 + np.exp(1))) < 1e-12


def test_company_names():
    known = frozenset(["foods", "mining", "software", "pharma", "services"])
    assert entity_match.parse_name("Public Limited Company FOODS Børvanik (Langby)", known)[:3] == ("borvanik", "foods", "plc")
    assert entity_match.parse_name("WorthiusSoftware spol. s r.o.", known)[:3] == ("worthius", "software", "sro")
    assert entity_match.parse_name("Vorik Pharmaceuticals Svcs Ltd", known)[:3] == ("vorik", "pharma services", "ltd")
    assert entity_match.parse_name("Foods Mining AS", known)[0] == "foodsmining" and entity_match.parse_name(None, known) == ("", "", "", "")


def test_most_candidates_are_no_matches(spark):
    """Sister firms and namesakes abroad outnumber the matches among the candidates; the mixture tells them apart, with no rule after it."""
    rec, lei, want = company_tables(spark)
    a, b = entity_match.records_side(rec), entity_match.leis_side(lei)
    common = entity_match.common_words(a)
    pairs = entity_match.candidates(entity_match.name_columns(a, common), entity_match.name_columns(b, common))
    assert pairs.count() > 1.5 * len(want)
    got = {(r.record_id, r.lei) for r in entity_match.match(rec, lei).collect()}
    assert len(got & set(want)) >= 0.95 * len(want) and len(got & set(want)) >= 0.95 * len(got)


SDN = "ent_num long, sdn_name string, sdn_type string, remarks string, name string"
WATCH = "list_name string, entry_id string, name string, entry_type string, program string, remarks string, aliases array<string>"


def test_linked_names(spark):
    sdn = [
        (1, "BELKAROV, Mikhail Toranovich", "individual", "DOB 25 May 1961; a.k.a. 'Misha Belkarov'", None), (2, "BELKAROV, Mikhail Toranovich", "individual", "DOB 03 Jan 1990", None), (3, "ZORLAMIN TRADING LLC", "-0-", "-0-", None),
        (4, "ZORLAMIN SHIPPING LLC", "-0-", None, None), (5, "BELKAROV, Svetlana", "individual", "DOB 25 May 1961", None), (None, "X", None, None, None), (6, None, None, None, None),
    ]
    watch = [
        ("EU", "EU-1", "Belkarow Misha", None, None, "born 1961-05-25", None), ("UN", "UN-1", "MIHAIL T. BÉLKÁROV", "P", None, "DOB: 25/05/1961", []), ("UK", "UK-1", "Zorlammin Trdg. Limited Liability Company", None, None, None, [None]),
        ("UK", "UK-2", "Sveta Belkarov", None, None, "year of birth 1961", None), ("EU", "EU-2", "Unrelated Name", None, None, None, None), ("EU", "EU-3", "", None, None, None, []),
    ]
    got = names.same_entity_pairs(names.linked_entries(spark.createDataFrame(sdn + sdn[:2], SDN), spark.createDataFrame(watch + watch[:2], WATCH)))
    assert rows(got) == [("EU-1", "SDN-1"), ("EU-1", "UN-1"), ("SDN-1", "UN-1"), ("SDN-3", "UK-1"), ("SDN-5", "UK-2")]
    none = names.linked_entries(spark.createDataFrame([], SDN), spark.createDataFrame([], WATCH))
    assert none.count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 2)], "a long, b long")
    assert sorted(r.comp for r in names.components(nodes, edges).collect()) == [0] * (n - 1) + [n - 1]


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961), ("DIXON", "DICKSONX", 0.813), ("", "x", 0.0), ("a", "a", 1.0)])
def test_jaro_winkler(a, b, want):
    assert abs(names.jaro_winkler(a, b) - want) < 0.002


def test_birth_dates():
    assert names.birth("DOB 03 May 1968; x") == (1968, "1968-05-03") and names.birth("born 1984-07-04") == (1984, "1984-07-04")
    assert names.birth("DOB: 15/04/1957; travel ban") == (1957, "1957-04-15") and names.birth("year of birth 1959") == (1959, None) and names.birth("x") == (None, None)


def test_short_tokens_one_edit_apart_meet(spark):
    for token in ("thirdao", "vanolo", "baro", "odd"):
        near = {token[:i] + c + token[i + 1 :] for i in range(len(token)) for c in "bkltmaeo"} | {token[:i] + c + token[i:] for i in range(len(token) + 1) for c in "bkltmaeo"}
        near |= {token[:i] + token[i + 1 :] for i in range(len(token))} | {token[:i] + token[i + 1] + token[i] + token[i + 2 :] for i in range(len(token) - 1)}
        assert all(names.codes(token) & names.codes(t) for t in near), token
    sdn = [(1, "THIRDAO, Mikhail", "individual", "DOB 25 May 1961", None), (2, "VANOLO, Svetlana", "individual", "DOB 03 Jan 1990", None)]
    watch = [("EU", "EU-1", "Thidrao Mikhail", None, None, "born 1961-05-25", None), ("EU", "EU-2", "Vakolo Svetlana", None, None, "born 1990-01-03", None)]
    got = names.same_entity_pairs(names.linked_entries(spark.createDataFrame(sdn, SDN), spark.createDataFrame(watch, WATCH)))
    assert rows(got) == [("EU-1", "SDN-1"), ("EU-2", "SDN-2")]


def entry(names_, remarks="DOB 25 May 1961", said="individual"):
    return names.profile(names.read_entry(names_, remarks, said), {})


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (["Carlos Perez"], ["Carlos Peres"], True), (["Carlos Perez"], ["Perez, Carlos"], True), (["Fatima Al Hassan"], ["Hassan, Fatima"], True), (["Fatima Al-Hassan"], ["HASSAN, F."], True),
        (["Alexander Petrov"], ["Petrov, Alexandr"], True), (["Li Wei"], ["WEI, Li"], True), (["Anneliese Oberhuber"], ["Oberhuber Annelise"], True), (["Carlos Perez"], ["Maria Perez"], False), (["Carlos Perez"], ["Carlos Gomez"], False),
        (["Ngozi Adaeze Okonkwo"], ["Okonkwo, Ngozi A."], True), (["Ngozi Adaeze Okonkwo"], ["Okonkwo, Ngozi Ifeoma"], False),
    ],
)
def test_names_outside_every_list(a, b, same):
    x, y = entry(a), entry(b)
    assert (names.score(x, y) > 0) == same
    assert not same or set(names.keys(x, {})) & set(names.keys(y, {}))


@pytest.mark.parametrize(("a", "b", "same"), [("Gazprombank", "Gasprombank", True), ("Nordhavn Maritime Services Ltd", "NORDHAVN MARITIME SVCS LIMITED", True), ("Nordhavn Maritime Ltd", "Nordhavn Mining Ltd", False), ("Nordhavn Maritime Ltd", "Nordhavn Maritime GmbH", False), ("Qin dao Heavy Industry", "Qindao Heavy Ind.", True)])
def test_organisations_outside_every_list(a, b, same):
    x, y = entry([a], None, "entity"), entry([b], None, None)
    assert (names.score(x, y) > 0) == same
    assert not same or set(names.keys(x, {})) & set(names.keys(y, {}))


def test_recall_and_precision_on_unseen_names(spark):
    """People whose names stand in no table, spelt three ways each: recall and precision of at least 0.95."""
    rng = random.Random(4)
    syllables = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n)) + rng.choice("nrslt")
    given = [syllables(2) for _ in range(40)]
    sdn, watch, truth = [], [], {}
    for i in range(150):
        first, last, day = rng.choice(given), syllables(3), f"19{rng.randrange(40, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"
        k = rng.randrange(1, len(last) - 1)
        typed = rng.choice([last[:k] + last[k + 1 :], last[:k] + last[k + 1] + last[k] + last[k + 2 :], last[:k] + rng.choice("aeiou") + last[k:]])
        sdn.append((i, f"{last.upper()}, {first.title()}" if i % 2 else f"{first} {last}", "individual", f"DOB {day}", None))
        watch.append(("EU", f"EU-{i}", f"{typed} {first}".title(), "P", None, f"born {day}", [f"{first} {last}"] if i % 3 == 0 else None))
        watch.append(("UN", f"UN-{i}", f"{first.upper()} {last.upper()}", None, None, f"year of birth {day[:4]}", None))
        truth.update({f"SDN-{i}": i, f"EU-{i}": i, f"UN-{i}": i})
    got = set(rows(names.same_entity_pairs(names.linked_entries(spark.createDataFrame(sdn, SDN), spark.createDataFrame(watch, WATCH)))))
    want = {tuple(sorted(p)) for i in range(150) for p in ((f"SDN-{i}", f"EU-{i}"), (f"SDN-{i}", f"UN-{i}"), (f"EU-{i}", f"UN-{i}"))}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got), (len(got), len(want), len(got & want))


def test_hot_groups_are_cut_without_loss(spark):
    left = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 99)], "k int, a int")
    right = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7)], "k int, b int")
    assert rows(names.split_join(left, right, ["k"], "b", most=4)) == rows(left.join(right, "k"))
