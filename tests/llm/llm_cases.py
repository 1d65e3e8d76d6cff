"""Helpers of these tests."""


def words(rng, n):
    """Random words of a small vocabulary."""
    return " ".join(rng.choice(("the", "of", "sea", "ship", "harbour", "tide", "and", "anchor", "le", "der", "que")) + str(rng.randrange(400)) for _ in range(n))


def plain(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
