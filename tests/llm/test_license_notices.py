"""Real notices of BSD and LGPL."""

from kinweave.llm import licenses

BSD3 = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU {} General Public
License as published by the Free Software Foundation; either
version {} of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful.
"""


def test_real_bsd_and_lgpl_notices(spark):
    texts = [BSD3, BSD3.split("3. Neither")[0], LGPL.format("Library", "2"), LGPL.format("Lesser", "2.1"), LGPL.format("Lesser", "3")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == ["BSD-3-Clause", "BSD-2-Clause", "LGPL", "LGPL", "LGPL"]
