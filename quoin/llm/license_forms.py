"""What licences look like in files: titles, header forms and the full texts (in ``license_texts``, by SPDX id)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib.resources import files

#: Ids whose full text is given.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")

_GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
_GNU_REST = """ This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""


def _gnu(name: str, version: str, date: str, what: str = "program") -> tuple[str, ...]:
    head = _GNU.format(what=what, name=name, version=version)
    only = f"under the terms of the GNU {name} version {version} as published by the Free Software Foundation."
    return (
        head, head + _GNU_REST.format(what=what, name=name), f"This {what} is free software; you can redistribute it and/or modify it {only}",
        f"GNU {name} Version {version}, {date}", f"GNU {name} version {version}", f"Licensed under the GNU {name}, version {version}.",
    )


#: Titles and header forms by id.
HEADERS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (*_gnu("Affero General Public License", "3", "19 November 2007"), "GNU Affero General Public License", "AGPL-3.0 License", "GNU AGPLv3"),
    "Apache-2.0": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
        """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed
with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License,
Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "New BSD License", "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC BY-NC 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-1.0-or-later": ("GNU General Public License",),
    "GPL-2.0": (*_gnu("General Public License", "2", "June 1991"), "GPLv2 License"),
    "GPL-3.0": (*_gnu("General Public License", "3", "29 June 2007"), "GPLv3 License"),
    "ISC": ("ISC License", "Licensed under the ISC License."),
    "LGPL-2.0-or-later": ("GNU Lesser General Public License", "GNU Library General Public License"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999", "library"),
    "LGPL-3.0": _gnu("Lesser General Public License", "3", "29 June 2007", "library"),
    "MIT": (
        "MIT License", "The MIT License", "The MIT License (MIT)", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "Licensed under the MIT License. See License.txt in the project root for license information.",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ),
    "MPL-2.0": (
        "Mozilla Public License Version 2.0", "Licensed under the Mozilla Public License, version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
}

# Short identifiers in headers.
_TAGS = {name: (f"SPDX-License-Identifier: {name}", f"License: {name}") for name in HEADERS}
_TAGS |= {n: (*t, *(f"SPDX-License-Identifier: {n}-{s}" for s in ("only", "or-later"))) for n, t in _TAGS.items() if "GPL-" in n and not n.endswith("later")}


def forms(notices: Mapping[str, str]) -> dict[str, tuple[str, ...]]:
    """``notices`` with titles, header forms, identifiers and full texts of the licences."""
    texts = {n: ((files("quoin.llm.license_texts") / f"{n}.txt").read_text(encoding="utf-8"),) for n in TEXTS}
    # The text of the AGPL is that of the GPL under its own name, but for the preamble and a section.
    texts["AGPL-3.0"] = (re.sub(r"(?i)\bGNU general\b", "GNU Affero General", texts["GPL-3.0"][0]),)
    names = sorted({*notices, *HEADERS})
    return {n: (*((notices[n],) if n in notices else ()), *HEADERS.get(n, ()), *_TAGS.get(n, ()), *texts.get(n, ())) for n in names}
