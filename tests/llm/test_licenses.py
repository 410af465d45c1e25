"""License notices as people write and wrap them."""

import pytest

from quillgraph.llm import license_scan

CASES = {
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "CC BY-NC 4.0, licensed under it": "cc-by,cc-by-nc",
    "Released under the Apache License": "apache",
    "Redistribution and use in source and binary forms,\nwith or without modification, are permitted": "bsd",
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software": "mit",
    "This Source Code Form is subject to the terms\nof the Mozilla Public License, v. 2.0": "mpl-2.0",
    "This library is free software; you can redistribute\nit and/or modify it under the terms\nof the GNU Lesser General Public License": "gpl,lgpl",
    "Permission to use, copy, modify, and/or distribute this software\nfor any purpose with or without fee is hereby granted": "isc",
    "Released\n\n\n\n\nunder the MIT License": "",
    "We released the software under the terms of a permission": "",
    "the public domain": "",
}


@pytest.mark.parametrize("tail", ["", "\nAnd other words\nfollow, the license of this work"])
def test_labels(spark, tail):
    rows = list(CASES.items())
    df = spark.createDataFrame([(k, t + tail, 0) for k, (t, _) in enumerate(rows)], "doc_id int, text string, words int")
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert [found[k] for k in range(len(rows))] == [label for _, label in rows]


def test_a_text_of_several_megabytes(spark):
    text = "a line of words that is no notice\n" * 100_000 + "Redistribution and use in source and binary\nforms, with or without modification, are permitted"
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()["labels"] == "bsd"
