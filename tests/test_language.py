import pytest
from pyspark.sql import functions as F

from codestrata.functions.language import classified, language, language_of_content, parser_name
from codestrata.operators.languages import with_language

FILES = [
    ("hello.py", '#!/usr/bin/env python\nprint "Hello"\n', "python"),
    ("hello-py3.py", '#!/usr/bin/env python\nprint("Hello")\n', "python"),
    ("hello.java", "public class Java {}\n", "java"),
    ("hello.js", 'console.log("Hello");\n', "javascript"),
    ("hello.bash", "#!/bin/bash\necho Hello\n", "shell"),
    ("hello.rb", "#!/usr/bin/env ruby\nputs 1\n", "ruby"),
    ("hello.go", "package main\n", "go"),
    ("hello.php", "<?php\necho 1;\n", "php"),
    ("hello.cpp", "#include <iostream>\n", "c++"),
    ("hello.cs", "class HelloWorld {}\n", "c#"),
    ("bin/tool", "#!/usr/bin/env python3\n", "python"),
    ("bin/run", "#!/bin/sh\n", "shell"),
    ("bin/env-flags", "#! /usr/bin/env -S node --harmony\n", "javascript"),
    ("deep/LICENSE", "free", "text"),
    ("UPPER.JAVA", "", "java"),
    ("src/Makefile", "all:\n", "makefile"),
    ("noise", "no first line", None),
    ("v1.2/noise", "", None),
    ("trailing.py\n", "", None),
    ("a.h", "#ifndef A\n#define A\nint f(void);\n#endif\n", "c"),
    ("b.h", "#pragma once\nnamespace n {\nclass A { public:\n};\n}\n", "c++"),
    ("c.h", "#import <x.h>\n@interface A : B\n@end\n", "objective-c"),
    ("empty.h", "", "c"),
    ("a.m", "@implementation A\n@end\n", "objective-c"),
    ("b.m", "% area\nfunction y = f(x)\n  y = x;\nend\n", "matlab"),
    ("a.pl", "use strict;\nmy $x = 1;\n", "perl"),
    ("b.PL", ":- module(m, [p/1]).\np(a).\n", "prolog"),
    ("a.ts", "import { a } from 'b';\n", "typescript"),
    ("b.ts", '<?xml version="1.0"?>\n<TS version="2.1">\n', "xml"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(
        [(path, content, bytearray(content.encode())) for path, content, _ in FILES],
        "file_path string, blob_content string, raw binary",
    )


def test_classified(files):
    got = {r[0]: r[1] for r in files.select("file_path", classified()).collect()}
    assert got == {path: lang for path, _, lang in FILES}


def test_binary_content_is_the_same(files):
    same = F.col("a").eqNullSafe(F.col("b"))
    both = files.select(language().alias("a"), language("file_path", "raw").alias("b"))
    assert both.where(~same).count() == 0


def test_given_language_skips_detection(files):
    given = F.when(F.col("file_path") == "hello.go", "Rust").otherwise("")
    got = {r[0]: r[1] for r in files.select("file_path", classified(override=given)).collect()}
    assert got["hello.go"] == "rust" and got["hello.rb"] == "ruby"


def test_parser_aliases(spark):
    names = spark.createDataFrame([("Shell",), ("C++",), ("C#",), ("Go",)], "n string")
    assert [r[0] for r in names.select(parser_name(F.col("n"))).collect()] == [
        "bash",
        "cpp",
        "csharp",
        "go",
    ]


def test_stored_language_is_the_same(files):
    """File lists get from contents what the expression gets from path and content."""
    hashed = files.withColumn("blob_hash", F.md5("raw"))
    contents = hashed.select(
        "blob_hash", F.col("raw").alias("blob_content"), language_of_content("raw").alias("content_language")
    ).dropDuplicates(["blob_hash"])
    lost = hashed.limit(1).select(F.lit("x/lost.h").alias("file_path"), F.lit("gone").alias("blob_hash"))
    listed = with_language(hashed.select("file_path", "blob_hash").unionByName(lost), contents)
    got = {r.file_path: r.language and r.language.lower() for r in listed.collect()}
    assert got == {**{path: lang for path, _, lang in FILES}, "x/lost.h": "c"}


def test_patterns_are_not_in_the_loop_over_rows(spark):
    """The JVM does not compile a loop over rows with the code of every pattern in it."""
    files = spark.createDataFrame([("a.h", "class A"), ("a.py", None)], "file_path string, blob_content string")
    found = files.select("file_path", language().alias("language")).where("language != 'Java'")
    generated = found._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" in generated and {row.language for row in found.collect()} == {"C++", "Python"}
    # A node whose stage is compiled as one method is marked with the number of the stage.
    assert all(not line.lstrip(" +-:").startswith("*") for line in generated.splitlines() if "RLIKE" in line)
