"""python tests/check_oracles.py [sf_dir] [name ...]: every query beside its SQL."""

import sys
import traceback

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from codicil.catalog.base import ORACLES, QUERIES, load_all  # noqa: E402
from codicil.session import local_session  # noqa: E402
from tests import oracle  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    load_all()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    bad = []
    for name, function in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, message, seconds = oracle.compare(spark, sf, con, name, function, ORACLES.get(name))
        except Exception as exc:
            ok, message, seconds = False, "".join(traceback.format_exception_only(exc))[:900], 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {name} [{'sql' if name in ORACLES else 'rows'}] {seconds:.1f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
