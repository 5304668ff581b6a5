import random

import pytest

from colophon.llm import names as N


@pytest.mark.parametrize(
    "a, b, level",
    [
        ("Smith, John", "John Smith", 2), ("Jon Smithh", "Jon Smith", 2), ("Bill Harper", "William Harper", 2), ("W. Harper", "William Harper", 1), ("Harper", "William Harper", 1), ("Harper W", "Mary Harper", 0),
        ("Mary Harper", "William Harper", 0), ("Dr. José Núñez Jr.", "Nunez, Jose", 2), ("Fidavistroem, Ursula", "Ursula Fidaviström", 2), ("T. N. Sogakimal", "Theodore N. Sogakimal", 1), ("Theodore K. Sogakimal", "Theodore N. Sogakimal", 0),
        ("Genome Study Grp. Berethim", "The Berethim-Genome Study Group", 2),
    ],
)
def test_agree(a, b, level):
    common = {"william", "mary", "john", "ursula", "theodore", "jose"}
    assert N.agree(N.parse(a), N.parse(b), common) == level


def test_parse():
    assert N.parse("et al.") is None and N.parse("[Author unknown]") is None and N.parse("...") is None
    assert N.parse("Pisupoawa ZK") == ("pisupoawa", "k.", "z.") and N.parse("O'Brien, Ann") == ("ann", "obrien")


def test_one_typing_error_shares_a_block():
    rnd = random.Random(4)
    for _ in range(300):
        t = "".join(rnd.choice("abdefgiklmnorstuvz") for _ in range(rnd.randint(5, 11)))
        k, c = rnd.randrange(1, len(t)), rnd.choice("abdeiklmorstu")
        typo = rnd.choice([t[:k] + t[k + 1 :], t[:k] + c + t[k:], t[:k] + c + t[k + 1 :], t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :] if k > 1 else t])
        x, y = N.block_keys((t, "w."), frozenset()), N.block_keys((typo, "w."), frozenset())
        assert {k for k, _ in x} & {k for k, _ in y}, (t, typo)


def test_variants(spark):
    given = ["William", "Mary", "John", "Ursula"]
    people = [f"{g} {s}" for s in ("Harperton", "Zubrowski", "Kalimero", "Dostanov", "Weberlin", "Ostrander", "Pellegrin", "Quintavo") for g in given[:2]]
    listed = people + ["Harperton, Bill", "Harpertn, William", "W. Harperton", "HARPERTON William", "M. Zubrowsky", "Zubrowski", "et al.", "", "John Solitary", "Mary​ Kalimero"]
    p = spark.createDataFrame([([x, None],) for x in listed] + [(None,), ([],)], "authors array<string>")
    c = spark.createDataFrame([(None, "Harperton", "William"), ("The Alpine Genome Consortium", None, None), ("Alpine-Genome Cons.", None, None), (None, "Lonely", None)], "name string, family string, given string")
    got = {frozenset((r.name_a, r.name_b)) for r in N.variant_pairs(p, c).collect()}
    one = ["William Harperton", "Harperton, Bill", "Harpertn, William", "W. Harperton", "HARPERTON William", "Harperton, William"]
    want = {frozenset((a, b)) for a in one for b in one if a < b} | {frozenset(("The Alpine Genome Consortium", "Alpine-Genome Cons.")), frozenset(("Mary Kalimero", "Mary​ Kalimero")), frozenset(("Mary Zubrowski", "M. Zubrowsky"))}
    assert got == want
    assert N.variant_pairs(p.limit(0), c.limit(0)).count() == 0


def test_common_tokens_count_where_all_tokens_agree():
    common = {"lijuhenen", "maria", "anna", "mei"}
    pairs = [("M. Lijuhenen", "Mei Lijuhenen", 1), ("M. Lijuhenen", "Marduk Lijuhenen", 1), ("Bob Lijuhenen", "Robert Lijuhenen", 2), ("Maria Lijuhenan", "Maria Lijuhenen", 2), ("Anna Lijuhenen", "Maria Lijuhenen", 0), ("M. K. Lijuhenen", "Mei Lijuhenen", 0), ("Lijuhenen", "Mei Lijuhenen", 0)]
    for a, b, level in pairs:
        x, y = N.parse(a), N.parse(b)
        assert N.agree(x, y, common) == N.agree(y, x, common) == level, (a, b)


def test_spellings_of_a_hot_surname_are_linked(spark):
    given = "Thanh Hoa|Corvin|Dagny|Elspeth|Fenwick|Gudrun|Hjalmar|Isolde|Jorund|Katrin|Leopold|Norbert|Ottilie|Perpetua|Quirin|Sigrid|Robert|Volkmar".split("|")
    names = [f"{g} Lijuhenen" for g in given] + ["C. Lijuhenen", "T. H. Lijuhenen", "Bob Lijuhenen", "Lijuhenen, Gudrun"]
    p = spark.createDataFrame([(k, [n]) for k, n in enumerate(names)], "record_id bigint, authors array<string>")
    c = spark.createDataFrame([], "name string, given string, family string")
    got = {tuple(r) for r in N.variant_pairs(p, c).collect()}
    assert got == {("C. Lijuhenen", "Corvin Lijuhenen"), ("T. H. Lijuhenen", "Thanh Hoa Lijuhenen"), ("Bob Lijuhenen", "Robert Lijuhenen"), ("Gudrun Lijuhenen", "Lijuhenen, Gudrun")}


def test_nicknames_of_names_with_two_vowels():
    for a, b in (("Sam Britarason", "Samuel Britarason"), ("Mike Notosila", "Michael Notosila"), ("Emeka Guvovaoni", "Chukwuemeka Guvovaoni")):
        assert N.agree(N.parse(a), N.parse(b), frozenset()) == 2, (a, b)


def test_surname_of_two_parts_and_works_decide(spark):
    rows = [
        (1, ["Zachary Mahobrort-Kubobuak"], None, None), (2, ["Z. Mahobrort-Kubobuak"], None, None),
        (3, ["Rajendra Malibruak"], "10.1234/one", "On the first of two works"), (4, ["Ragnhild Malibruak"], "10.1234/two", "On the second of two works"),
        (5, ["Malibruak R"], None, "ON THE FIRST of two works."), (6, ["R. Zosaraadze"], None, None), (7, ["Robert Zosaraadze"], None, None), (8, ["Rosa Zosaraadze"], None, None),
    ]
    p = spark.createDataFrame(rows, "record_id bigint, authors array<string>, doi string, title string")
    c = spark.createDataFrame([("Malibruak, R.", None, None, "https://doi.org/10.1234/ONE")], "name string, given string, family string, work_doi string")
    got = {frozenset(r) for r in N.variant_pairs(p, c).collect()}
    one = ["Malibruak R", "Malibruak, R.", "Rajendra Malibruak"]
    assert got == {frozenset(("Zachary Mahobrort-Kubobuak", "Z. Mahobrort-Kubobuak"))} | {frozenset((a, b)) for a in one for b in one if a < b}
    assert N.variant_pairs(p.drop("doi"), c.drop("work_doi")).count() == 2  # without works: Mahobrort-Kubobuak, and the spellings of R. Malibruak


def test_pairs_that_cannot_agree_end_in_the_join(spark):
    """People who share a surname, or a misspelt given name, are no pairs; typing errors, nicknames and initials are."""
    common = frozenset("william mary johannes ursula zachary".split())
    listed = ["harperton mary", "harperton william", "bill harperton", "harpertn william", "harperton w.", "harperton ursula", "kalimero wiliam", "wiliam zubrowski", "harperton ursulla"]
    form = spark.createDataFrame(list(enumerate(listed)), "id bigint, form string")
    got = {frozenset((r.form_a, r.form_b)) for r in N.meetings(form, spark.sparkContext.broadcast(common)).collect()}
    want = {frozenset((a, b)) for a in listed for b in listed if a != b and N.agree(tuple(a.split(" ")), tuple(b.split(" ")), common)}
    assert want <= got and len(want) == 7
    for a, b in (("harperton mary", "harperton william"), ("harperton william", "harperton ursula"), ("kalimero wiliam", "wiliam zubrowski")):
        assert frozenset((a, b)) not in got, (a, b)


def test_pairs_that_agree_always_fit(spark):
    rnd, common = random.Random(7), frozenset("william mary johannes ursula zachary alexander dmitri".split())
    words = [*common, *sorted(N._NICK_WORDS)[::5], "harperton", "zubrowski", "kalimero", "dostanov", "anna", "anne", "lue"]
    pairs = []
    for _ in range(6000):
        a = [rnd.choice(words) for _ in range(rnd.randint(2, 4))]
        b = [rnd.choice(sorted(N._NICK.get(t, (t,)))) for t in a]
        i = rnd.randrange(len(b))
        for _ in range(rnd.randrange(3)):
            t, k = b[i], rnd.randrange(1, len(b[i]))
            b[i] = rnd.choice([t[:k] + t[k + 1 :], t[:k] + rnd.choice("aeklo") + t[k:], t[: k - 1] + t[k] + t[k - 1] + t[k + 1 :]])
            if len(b[i]) < 2:
                break
        a, b = tuple(sorted(a)), tuple(sorted(b))
        if N.agree(a, b, common) or N.agree(b, a, common):
            pairs.append((N.fit_code(a, common), N.fit_code(b, common)))
    assert len(pairs) > 3000 and all(x >= 0 for p in pairs for x in p)
    assert spark.createDataFrame(pairs, "fit_a bigint, fit_b bigint").where(f"not {N.fits()}").count() == 0
