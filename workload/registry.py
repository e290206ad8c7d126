"""Name -> (query, SQL). A query takes (spark, sf_dir) and returns a DataFrame."""

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return register


from workload import queries_gold, queries_sources, queries_tracks, queries_views  # noqa: E402,F401,I001
from workload import queries_stored  # noqa: E402,F401  restates SQL of the others
