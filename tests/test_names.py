import pytest

from docweave.functions import names


@pytest.mark.parametrize(
    "mention, candidate, truncated, score, method",
    [
        ("ACME Corp", "Acme Corporation", False, 1.0, "normalized"),
        ("Red Wood Timber", "Redwood Timber", False, 0.97, "spacing"),
        ("BFG", "Blenheim Foods Group", False, 0.85, "acronym"),
        ("Castlemead Log.", "Castlemead Logistics", False, 0.95, "abbreviation"),
        ("Falcon Aero Components", "Falcon Aerospace Components", False, 0.967, "abbreviation"),
        ("Sterling Pharmaceuticals", "Sterling Pharma", False, 0.925, "expansion"),
        ("Kingsly Textiles", "Kingsley Textiles", False, 0.925, "typo"),
        ("Blenhiem Foods", "Blenheim Foods Group", False, 0.885, "truncation+typo"),
        ("Witmore Dairy", "Whitmore Dairy Products", False, 0.885, "truncation+typo"),
        ("Redwood Timber", "Redwood Timber & Joinery", False, 0.96, "truncation"),
        ("Whitmore Dairy Products", "Whitmore Dairy", False, 0.973, "truncation"),
        ("Falcon Aerospace C", "Falcon Aerospace Components", True, 0.967, "abbreviation"),
    ],
)
def test_company(mention, candidate, truncated, score, method):
    found = names.match_company(mention, candidate, truncated)
    assert found[0] == pytest.approx(score) and "+".join(sorted(found[1])) == method


@pytest.mark.parametrize("mention, candidate", [("Acme Robotics", "Acme"), ("Redwood Joinery", "Redwood Timber"), ("Redwood Timber Supplies", "Redwood Timber & Joinery"), ("", "Acme")])
def test_no_company(mention, candidate):
    assert names.match_company(mention, candidate) is None


def test_domains():
    assert names.match_domain("ironbridgeauto.co.uk", "Ironbridge Automotive Ltd")[0] == names.DOMAIN
    assert names.match_domain("acmecorp.com", "Acme Corporation") and names.match_domain("acme.com", "Acme Corporation Ltd")
    assert names.match_domain("acmex.com", "Acme Corporation") is None and names.match_domain("bacme.com", "Acme") is None


def test_distances():
    assert names.edit_distance("blenhiem", "blenheim") == 1 and names.edit_distance("ca", "abc") == 3 and names.edit_distance("", "ab") == 2
    assert names.ratio("", "") == 100 and names.ratio("abcd", "abxd") == 75 and names.ratio("a", "") == 0


def test_support():
    assert names.supports_name("Whitmore Dairy Products", "Whitmore Dairy") == 0 and names.supports_name("Whitmore Dairy", "Whitmore Dairy Products") > 0.9
