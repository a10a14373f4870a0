"""Brute-force counterparts and small fixtures for the training-data operators."""

LONG = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi "
        "chi psi omega one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
        "seventeen eighteen nineteen twenty red green blue yellow black white brown grey orange purple").split()


def components(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def docs_of(spark, rows, extra=True):
    """``documents`` rows with columns whose names clash with those that operators use or return."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        schema += ", kept string, count long, id string, fp long, key string, hits string, score double"
        rows = [(*r, "x", 1, "i", 2, "k", "h", 0.5) for r in rows]
    return spark.createDataFrame(rows, schema)


def doc(i, text, lang="en"):
    return (i, text, lang, "src0", None if text is None else len(text))
