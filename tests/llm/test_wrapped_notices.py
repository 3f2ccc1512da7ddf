"""Licence notices as they stand in files: wrapped, behind comment marks, amid prose."""

import textwrap

import pytest

from proofmill.llm import licenses

NOTICES = {
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
PROSE = "The quick brown fox jumps over the lazy dog while rain falls on the quiet town and nobody sees it."


def wrapped(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize("mark", ["", " * ", "# "])
@pytest.mark.parametrize("width", [40, 70, 80])
def test_wrapped_notices_are_found(spark, mark, width):
    rows = []
    for k, notice in enumerate(NOTICES.values()):
        body = wrapped(notice, width, mark)
        rows += [(3 * k, body), (3 * k + 1, f"{mark}Copyright 2020 by the authors\n{mark}\n{body}\n{mark}\nint main()"), (3 * k + 2, "\n".join([PROSE] * 9 + [body] + [PROSE] * 30))]
    rows += [(1000 + k, "\n".join([PROSE] * (k + 1))) for k in range(200)]
    report = licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["license"] for r in report.collect()}
    want = {3 * k + j: f for k, f in enumerate(NOTICES) for j in range(3)} | {1000 + k: "none" for k in range(200)}
    assert {i: v for i, v in got.items() if v != want[i]} == {}
