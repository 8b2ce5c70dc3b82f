from pyspark.sql import functions as F

from listwright.functions.rules import TierRules
from listwright.operators import tiering

RULES = TierRules(
    named=("acme", "big.co", "hex"),
    keywords=(r"\bstrategy\b", r"\bgo.to.market\b", r"ops\b"),
    skips=(r"\bengineer\b", r"\bquant\b"),
)


def tiers(apply, pairs, rules=RULES):
    return apply(rules.tier, pairs, "c string, t string")


def test_priority_and_scope(apply):
    cases = {
        ("Acme Labs", "Engineer"): "named_target",
        ("ACME", "x"): "named_target",
        ("acmeology", "x"): "skip",
        ("Big.Co", "x"): "named_target",
        ("BigxCo", "x"): "skip",
        ("Other", "Strategy Engineer"): "skip",
        ("Engineer Inc", "Strategy"): "keyword",
        ("Strategy House", "Intern"): "keyword",
        ("Other", "GO-TO-MARKET lead"): "keyword",
        ("Other", "go\nto\nmarket"): "skip",
        ("Other", "devops"): "keyword",
        ("Other", "Intern"): "skip",
        ("", ""): "skip",
    }
    assert tiers(apply, list(cases)) == list(cases.values())


def test_word_boundaries_count_letters_of_all_scripts(apply):
    pairs = [("éhex", ""), ("hexé", ""), ("é hex é", ""), ("hex_", ""), ("hex²", ""), ("(hex)", "")]
    assert tiers(apply, pairs) == ["skip", "skip", "named_target", "skip", "skip", "named_target"]


DEFAULT_CASES = [
    # company, title, tier
    ("Ramp", "Quant", "named_target"),
    ("ramps", "Intern", "skip"),
    ("The RAMP Company", "ML Engineer", "named_target"),
    ("Scale AI", "Full stack", "named_target"),
    ("scale-ai", "Intern", "skip"),
    ("Plain", "Strategy and Operations", "keyword"),
    ("Plain", "Go-To-Market", "keyword"),
    ("Plain", "APM", "keyword"),
    ("Plain", "apmx", "skip"),
    ("Plain", "Quantitative Strategy", "skip"),
    ("Plain", "Strategy quants", "keyword"),
    ("Plain", "AI Engineer", "keyword"),
    ("Plain", "ML Engineer, applied AI", "skip"),
    ("Defense Co", "Intern", "keyword"),
    ("Defense Co", "Embedded", "skip"),
    ("Defense Co", "émbedded", "keyword"),
    ("Quant House", "BizOps", "keyword"),
    ("Strategy", "Full stack", "skip"),
    ("Strategy", "Full  stack", "keyword"),
    ("Plain", "Technical Program", "keyword"),
    ("Plain", "Plain", "skip"),
    ("", "", "skip"),
]


def test_default_rules(apply):
    pairs = [(company, title) for company, title, _ in DEFAULT_CASES]
    assert tiers(apply, pairs, TierRules()) == [tier for _, _, tier in DEFAULT_CASES]


def test_empty_rule_lists_match_nothing(apply):
    nothing = TierRules(named=(), keywords=(), skips=())
    assert tiers(apply, [("acme", "engineer")], nothing) == ["skip"]
    assert apply(nothing.matched_terms, [("acme", "engineer")], "c string, t string") == [[]]


def test_matched_terms_of_the_deciding_list(apply):
    pairs = [("Acme and HEX", "quant"), ("Other", "Strategy devops strategy"), ("x", "Quant x"),
             ("x", "y")]
    assert apply(RULES.matched_terms, pairs, "c string, t string") == [
        ["acme", "hex"], ["strategy", "ops"], ["quant"], [],
    ]


def test_presets(spark):
    rows = spark.createDataFrame(
        [("Acme", "a"), ("x", "strategy"), ("x", "y")], "company_name string, title string"
    )
    tiered = tiering.with_tier(rows, RULES)

    def count(preset):
        return tiering.in_tiers(tiered, preset).count()

    assert (count("tier1"), count("tier2"), count("all"), count(("skip",))) == (1, 1, 2, 1)
    counts = {r.tier: r.n for r in tiering.tier_counts(tiered).collect()}
    assert counts == {"named_target": 1, "keyword": 1, "skip": 1}
    assert set(counts) == {r.tier for r in tiered.select(F.col("tier")).collect()}
