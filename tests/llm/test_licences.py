"""Recall and precision of the licence scan on notices whose wording it was not trained on."""

from collections import Counter, defaultdict

from auditweave.llm import license_scan

#: Notices as they stand in projects; none is a template.
KEPT_OUT = (
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Code released under the MIT License, see LICENSE for details."),
    ("mit", "// SPDX-License-Identifier: MIT"),
    ("mit", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (see LICENSE)."),
    ("apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "The source code is released under the Apache 2.0 license by the authors."),
    ("apache-2.0", "   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at"),
    ("bsd", "Distributed under the two-clause BSD license, see COPYING."),
    ("bsd", "Licensed under the BSD 3-Clause License (see LICENSE.txt)."),
    ("bsd", " * SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this\nlist of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("isc", "This module is licensed under the ISC License."),
    ("gpl", "Distributed under the terms of the GNU General Public License v2"),
    ("gpl", "Distributed under the terms of the GNU GPL v3 or later."),
    ("gpl", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ("gpl", "This work is licensed under the GNU General Public License version 3 or any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License."),
    ("agpl", "The server is licensed under the GNU Affero General Public License, version 3 or later."),
    ("agpl", "# SPDX-License-Identifier: AGPL-3.0-only"),
    ("lgpl", "The library is licensed under the GNU Lesser General Public License, version 2.1 or later."),
    ("lgpl", "# SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at the site."),
    ("mpl-2.0", "The library is licensed under the Mozilla Public License, version 2.0 only."),
    ("epl-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at the site."),
    ("epl-2.0", "// SPDX-License-Identifier: EPL-2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("zlib", "The code is licensed under the zlib License."),
    ("cc-by", "All text is licensed under CC BY 4.0 unless noted."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License by the editors."),
    ("cc-by-sa", "The pictures are licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; more terms may apply."),
    ("cc-by-nc", "The data set is licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This book is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("public-domain", "The data are dedicated to the public domain under CC0 1.0."),
    ("public-domain", "This is free and unencumbered software released into the public domain by its author."),
    ("proprietary", "Copyright 2019 Example Press. All rights reserved."),
    ("proprietary", "Reproduction in whole or part without written permission is prohibited."),
)

#: Sentences that share words with notices and are none.
PLAIN = (
    "The driver showed his license and the papers of the car to the officer.", "A new version of the software was released in May.",
    "The public library is open on all days and free of charge for students.", "She asked for permission to copy the key of the house.",
    "The rights of the workers were the subject of the meeting.", "The foundation published the second part of the work last year.",
    "He was free to use the road without any warranty of good weather.", "The general terms of the contract are on the next page.",
)


def test_recall_and_precision_per_family(spark):
    ordinary = [(1000 + i, f"ordinary words number {i} about the weather in spring and {i * 7} birds") for i in range(300)]
    rows = [(i, text) for i, (_, text) in enumerate(KEPT_OUT)] + [(500 + i, text) for i, text in enumerate(PLAIN)] + ordinary
    found = defaultdict(set)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        if r["family"] != license_scan.UNKNOWN:
            found[r["doc_id"]].add(r["family"])
    right, asked, told = Counter(), Counter(family for family, _ in KEPT_OUT), Counter()
    for i, (family, _) in enumerate(KEPT_OUT):
        right[family] += found[i] == {family}
        told.update(found[i])
    assert not [i for i in found if i >= 500 and found[i]]
    assert all(right[f] >= 0.9 * n for f, n in asked.items()), {f: (right[f], n) for f, n in asked.items()}
    assert all(right[f] >= 0.9 * n for f, n in told.items()), {f: (right[f], n) for f, n in told.items()}
    assert "gpl" not in found[[f for f, _ in KEPT_OUT].index("agpl")]


def test_only_texts_that_can_reach_a_family_go_on(spark):
    words = {1: ["mit"], 2: ["the", "mit"], 3: ["mit", "license"], 4: ["weather"]}
    model = license_scan.Model(["mit", "unknown"], {1: [1.0, 0.0], 2: [2.0, 0.0], 3: [3.0, -1.0], 4: [0.0, 5.0]}, [-5.0, 0.0], 1.0, 0.0, words)
    texts = ["the MIT, license", "The mit; a license", "mit license", "mit\nLicense weather", "license the mit", "", "nothing", "(mit) the license mit"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    gains = model.gains(0.5)
    got = [r[0] for r in df.select(license_scan.may_be_notice(df.text, gains)).collect()]
    assert got == [True, False, True, True, False, False, False, False] and gains[0].keys() == {"mit", "the mit", "mit license"}
    assert license_scan.Model(["mit", "unknown"], {}, [1.0, 0.0], 1.0, 0.0, {}).gains(0.5) is None
