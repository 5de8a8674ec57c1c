"""Licence texts and notices; the expected labels come from the texts, not from the templates."""

import re

import pytest

from stratum.llm.licenses import op10_license_templates, scan, words_of
from tests.conftest import SF01

GRANT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
         'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
         'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
         'persons to whom the Software is furnished to do so')
CONDITIONS = (', subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included '
              'in all copies or substantial portions of the Software.\n')
AS_IS = ('\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
         'WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR '
         'COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR '
         'OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.')
BSD = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
       'conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions '
       'and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of '
       'conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n')
ADVERT = ('3. All advertising materials mentioning features or use of this software must display the following acknowledgement: '
          'This product includes software developed by the organization.\n')
NAMES = ('Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products '
         'derived from this software without specific prior written permission.\n')
BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
             'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
             'DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, '
             'SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR '
             'SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, '
             'WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE '
             'OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", {"mit"}),
    ("MIT License\n\nCopyright (c) 2020 A B\n\n" + GRANT + CONDITIONS + AS_IS, {"mit"}),
    (GRANT + "." + AS_IS, {"mit-0"}),
    (GRANT + CONDITIONS + "The Software shall be used for Good, not Evil.\n" + AS_IS, {"json"}),
    ("MIT License\n" + GRANT + CONDITIONS.replace("all copies", "no copies") + AS_IS, set()),
    (GRANT + CONDITIONS, set()),
    (BSD + BSD_AS_IS, {"bsd-2-clause"}),
    (BSD + "3. " + NAMES + BSD_AS_IS, {"bsd-3-clause"}),
    (BSD + ADVERT + "4. " + NAMES + BSD_AS_IS, {"bsd-4-clause"}),
    (BSD + "3. Not for sale.\n" + BSD_AS_IS, set()),
    ("Distributed under the BSD 3-Clause License.", {"bsd-3-clause"}),
    ("available under the terms of the Mozilla Public License, v. 2.0.", {"mpl-2.0"}),
    ("licensed under the GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
     "of the License", {"agpl-3.0"}),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of "
     "the License, or (at your option) any later version.", {"gpl-2.0"}),
    ("Licensed under the ISC License", {"isc"}),
])
def test_texts(text, labels):
    assert scan(words_of(text.encode()))[1] == labels


def test_every_licence_line_has_a_label(spark):
    lines = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
             "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "All rights reserved.": "reserved",
             "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0"}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    seen = set()
    for r in op10_license_templates(spark, SF01).collect():
        for line in re.findall("|".join(map(re.escape, lines)), texts[r["doc_id"]]):
            seen.add(line)
            assert lines[line] in r["labels"].split(",")
    assert seen == set(lines)
