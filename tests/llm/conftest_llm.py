"""Names that several test modules share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
