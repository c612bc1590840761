"""``python -m eventloom`` lists functions; ``python -m eventloom NAME --argument value ... [out.json]`` calls one."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from eventloom import registry

    if not args or args[0] in ("-h", "--help"):
        for f in registry.list_functions():
            print(f["name"], *(f"--{a}" for a in f["args"]["properties"]), "-", f["doc"])
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("eventloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    name, rest, given, out = args[0], args[1:], {}, None
    while rest:
        if rest[0].startswith("--") and len(rest) > 1:
            given[rest[0][2:]] = rest[1]
            rest = rest[2:]
        else:
            out, rest = rest[0], rest[1:]
    result = registry.as_json(registry.Registry(spark).call(name, **given))
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(result)
    else:
        print(result)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
