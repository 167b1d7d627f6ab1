from gridloom.llm import licenses
from tests.oracle import run_sql, same


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert same(licenses.scan(licenses.as_files(docs)).toPandas(), run_sql(licenses.ORACLE_SQL, sf))


def test_inheritance_and_odd_rows(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [
        (1, "LICENSE", mit), (2, "a/x.py", "nothing here"), (3, "a/b/COPYING", gpl), (4, "a/b/c/y.py", None), (5, "a/b/z.py", f"text\n{mit}\nmore text than the notice has, by far and wide"),
        (6, None, "words"), (7, "q/notice.txt", f"{gpl}\n{mit}"), (7, "q/notice.txt", f"{gpl}\n{mit}"), (None, "q/r", ""), (8, "a/only", gpl.upper()), (9, "long/t", "mit " * 50_000),
    ]
    files = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, path string, text string, dir string, score int")
    got = {r.doc_id: r for r in licenses.scan(files).collect()}
    assert got[1].licence == "MIT" and got[1].basis == "own"
    assert (got[4].licence, got[4].basis, got[4].from_dir) == ("GPL-3.0", "inherited", "a/b")
    # a/only is all licence text, so it gives its licence to the folder a
    assert (got[2].licence, got[2].from_dir) == ("GPL-3.0", "a")
    assert got[5].own_licence == "MIT" and got[6].basis == "none" and got[7].licence == "GPL-3.0"
    assert got[None].licence == "GPL-3.0" and (got[9].licence, got[9].from_dir) == ("MIT", "")
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.licence_lines(licenses.as_files(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_headers_and_whole_licences(spark):
    apache = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
    code = "\n".join(f"value{i} = load(source{i}, target{i})" for i in range(300))
    whole = {name: " ".join(w for w, n in zip(*[iter(text.split())] * 2) for _ in range(int(n))) for name, text in reversed(licenses.BLOCKS)}
    rows = [(1, "a/x.py", apache + code), (2, "b/x.c", f"{code}\n{gpl}\n{code}"), (3, "m/LICENSE", "Copyright (c) 2020 Jane Doe\n" + whole["MIT"]), (4, "m/src/y.py", code), (5, "g/text", whole["GPL-3.0"]), (6, "g/z", code), (7, None, whole["MIT"])]
    rows += [(8 + i, f"n/{i}.txt", f"other plain text number{i} of the software and the license") for i in range(20)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan(files).collect()}
    assert len(got) == len(rows)
    assert [(got[i].licence, got[i].basis) for i in range(1, 8)] == [("Apache-2.0", "own"), ("GPL-3.0", "own"), ("MIT", "own"), ("MIT", "inherited"), ("GPL-3.0", "own"), ("GPL-3.0", "inherited"), ("MIT", "own")]
    assert all(got[8 + i].basis == "none" for i in range(20))


def test_notices_inside_longer_lines(spark):
    rows = [
        (1, "a/x", "This tool does many useful things for its users every day. Released under the MIT License. See the docs for how to install it.\nmore"),
        (2, "b/x", "First! Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. Copyright of the authors and others since long ago."),
        (3, "c/x", "It says nothing of rights. The public house has a free version, and other sentences. Nothing more."),
        (4, "d/x", "Some words come before it here.  This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. And some after it."),
    ]
    rows += [(9 + i, f"n/{i}", f"plain text number{i} of the software, released under the public house. More of the same.") for i in range(30)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[i].own_licence for i in (1, 2, 3, 4)] == ["MIT", "BSD-3-Clause", None, "MPL-2.0"]
    assert all(got[9 + i].own_licence is None for i in range(30))
