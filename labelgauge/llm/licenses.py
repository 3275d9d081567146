"""Licence scans: sparse TF-IDF cosine to templates and nearest-ancestor inheritance, in DataFrame functions.

A file is compared in units: its lines, its paragraphs (lines up to one without a letter or digit, so also
within comments), its leading comment, and a licence file as a whole. Only units that speak of licences
(``ANCHOR``, as every template does) are compared; a unit that many files share is compared once.
Vectors hold the terms that are not stop words, weighted by count and inverse document frequency over all
distinct units; a template's term that no unit has, and a term of no template, weigh as they are found.
All else is joins on terms. Templates are one-line notices, standard headers, and full texts where these
are short; of long licences the title, the preamble's start and the standard header are compared.

Of several matches those of leading comments and whole licence files with whole templates come first, then
lines and paragraphs; reserved rights come last whatever their score. A file without a licence of its
own takes that of the licence file in the nearest directory above it; where that file says nothing known,
what is below is ``unknown``, not the licence of a directory further up.

Null paths are no files; null and empty texts match nothing. Rows with equal paths count as one file, equal
scores go to the first template, then the first line. An empty table gives an empty one. Only ``path`` and
``text`` are read, whatever other columns there are.
"""

from pyspark.sql import functions as F

from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

#: Notices, headers and texts by licence; paragraphs are parted by blank lines.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later
version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library. If not, see
<https://www.gnu.org/licenses/>."""),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free
Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"""),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Proprietary", "Copyright. All rights reserved."),
]
#: Words that say nothing about a licence; what a unit must speak of; what starts a comment.
STOPS = "a all and any are by for free in is it of or person subject terms the this to under use with work".split()
ANCHOR = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|rights reserved"
COMMENT = (
    r"(?s)^(?:#![^\n]*+\n)?+(?:\s*+(?:/\*.*?\*/|<!--.*?-->)|(?:[ \t]*+(?:#|//|--|;|%|\*)[^\n]*+(?:\n|$))++)"
)
BLANK = r"\r?\n(?:[^\p{L}\p{N}\n]*+\n)++"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
LEAST = 0.7
#: Line numbers of units that are no lines: a whole licence file, the leading comment; paragraphs go below.
WHOLE, LEADING, FIRST_PARAGRAPH = -1, -2, -3


def terms(text):
    """Terms of a text: runs of letters, digits and inner dots, lower case, without stop words."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.+(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.+", -1)
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOPS))


def templates(spark):
    """(template, license, whole, term, n) of the fixed notices.

    A text of several paragraphs is a ``whole`` template, for leading comments and licence files, and its first
    paragraph one for lines and paragraphs.
    """
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        first, _, rest = text.partition("\n\n")
        rows += [(2 * i, name, False, first)] + [(2 * i + 1, name, True, text)] * bool(rest)
    values = [F.struct(*[F.lit(v).alias(c) for c, v in zip(("template", "license", "whole", "text"), row)]) for row in rows]
    rows = spark.range(1).select(F.inline(F.array(*values)))
    rows = rows.select("template", "license", "whole", F.explode(terms(F.col("text"))).alias("term"))
    return rows.groupBy("template", "license", "whole", "term").agg(F.count("*").alias("n"))


def units(files):
    """(path, line, part): the units of each file that speak of licences."""
    texts = files.where(F.col("path").isNotNull()).select("path", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = texts.where(F.col("text").rlike(ANCHOR))
    comment = F.regexp_extract("text", COMMENT, 0)
    texts = texts.withColumn("lead", comment).withColumn("rest", F.expr("substr(text, length(lead) + 1)"))
    lines = F.transform(F.split("text", "\r?\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("part")))
    # the end of the leading comment ends a paragraph, too
    paragraphs = F.concat(F.split("lead", BLANK, -1), F.split("rest", BLANK, -1))
    paragraphs = F.transform(paragraphs, lambda x, i: F.struct((F.lit(FIRST_PARAGRAPH) - i).alias("line"), x.alias("part")))
    paragraphs = F.filter(paragraphs, lambda u: F.trim(u["part"], F.lit(" \r\n")).contains("\n"))  # one line is a line
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.col("text"))
    others = F.array(
        F.struct(F.lit(WHOLE).alias("line"), whole.alias("part")), F.struct(F.lit(LEADING).alias("line"), F.col("lead").alias("part"))
    )
    found = texts.select("path", F.inline(F.concat(lines, paragraphs, others)))
    return found.where(F.col("part").rlike(ANCHOR))


def scan(files, least=LEAST):
    """(path, license, score, line) of the best match of each file that has one of ``least`` or more.

    ``files``: path and text. ``line`` is the number of a line, WHOLE, LEADING, or FIRST_PARAGRAPH - i for
    paragraph i.
    """
    spark = files.sparkSession
    found = units(files).withColumn("same", F.xxhash64("part")).withColumn("again", F.xxhash64(F.reverse("part")))
    found = stored(found, shared_dir(spark, "license-units"))
    known = templates(spark)
    distinct = found.groupBy("same", "again").agg(F.min("part").alias("part"))
    exploded = distinct.select("same", "again", F.explode(terms(F.col("part"))).alias("term"))
    counts = stored(exploded.groupBy("same", "again", "term").agg(F.count("*").alias("n")), shared_dir(spark, "license-terms"))
    n = F.lit(distinct.count())
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log((n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighed = known.join(df, "term", "left").withColumn("w", F.col("n") * weight).drop("df", "n")  # the templates' terms
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    weighed = weighed.join(norms, "template").select("template", "license", "whole", "term", (F.col("w") / F.col("norm")).alias("w"))
    counts = counts.join(df, "term").select("same", "again", "term", (F.col("n") * weight).alias("x"))
    length = counts.groupBy("same", "again").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("length"))
    # templates are fixed, so their terms are broadcast whatever the data
    dots = counts.join(F.broadcast(weighed), "term").groupBy("same", "again", "template", "license", "whole")
    dots = dots.agg(F.sum(F.col("x") * F.col("w")).alias("dot")).join(length, ["same", "again"])
    dots = dots.withColumn("score", F.round(F.least(F.col("dot") / F.col("length"), F.lit(1.0)), 6)).where(F.col("score") >= least)
    large = F.col("line").isin(WHOLE, LEADING)
    met = found.select("path", "line", "same", "again").join(dots, ["same", "again"]).where(~F.col("whole") | large)
    rank = F.struct(
        (F.col("license") != "Proprietary").alias("known"), (F.col("whole") & large).alias("whole"), "score",
        (-F.col("template")).alias("template"), F.when(large, F.col("line")).otherwise(-F.abs("line")).alias("place"), "license", "line",
    )
    best = met.groupBy("path").agg(F.max(rank).alias("b"))
    return best.select("path", "b.license", "b.score", "b.line")


def parent(path):
    """The directory of a path, without its last slash; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(paths, matches):
    """(path, source_directory, inherited): the licence of the nearest directory above that has a licence file.

    ``inherited`` is null where that file has no known licence. Directories are looked up, not files: each
    directory once, with all directories above it, by a join.
    """
    files = paths.where(F.col("path").rlike(LICENSE_FILE)).select("path").join(matches, "path", "left")
    own = files.groupBy(parent(F.col("path")).alias("above")).agg(F.max(F.struct("score", "license", "path")).alias("b"))
    own = own.select("above", "b.license")
    dirs = paths.select(parent(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/", -1)
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(parts))
    ups = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")
    ))
    found = dirs.select("directory", F.explode(ups).alias("u")).select("directory", "u.*").join(own, "above")
    near = found.groupBy("directory").agg(F.max(F.struct("depth", "above", "license")).alias("b"))
    near = near.select("directory", F.col("b.above").alias("source_directory"), F.col("b.license").alias("inherited"))
    return paths.select("path", parent(F.col("path")).alias("directory")).join(near, "directory").drop("directory")


def licensed(files, least=LEAST):
    """Per path: license, score, how (own, inherited, unknown or none) and the directory it is inherited from.

    ``unknown``: the nearest licence file above (or the file itself) has no known licence. One row per
    path; columns other than ``path`` and ``text`` are not carried.
    """
    files = files.select("path", "text")
    paths = files.where(F.col("path").isNotNull()).select("path").distinct()
    matches = stored(scan(files, least), shared_dir(files.sparkSession, "licenses"))
    rows = paths.join(matches, "path", "left").join(inherited(paths, matches), "path", "left")
    above = F.col("source_directory").isNotNull()
    how = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").when(above, "unknown")
    taken = F.when(F.col("license").isNull(), F.col("source_directory"))
    return rows.select(
        "path", F.coalesce("license", "inherited").alias("license"), "score", F.coalesce(how, F.lit("none")).alias("how"),
        taken.alias("source_directory"),
    )
