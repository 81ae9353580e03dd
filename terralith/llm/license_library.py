"""License notices beyond the few best known ones, and full license texts.

Names are SPDX identifiers with a suffix for the form (``-short``, ``-header``). A notice that
differs from another one by its version alone is cut to the words around the version, so that
the other version's notice does not reach the containment threshold. Full texts lie in
``license_texts``; only the driver reads them.
"""

from __future__ import annotations

from pathlib import Path

_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_CC_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
_GNU = "GNU {} as published by the Free Software Foundation"
_NOTICES = {
    "Apache-2.0-under": "under the terms of the Apache License 2.0",
    "Apache-1.1-name": "Apache Software License, Version 1.1",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-project": "This project is licensed under the MIT License",
    "BSD-licensed": "Licensed under the BSD License.",
    "BSD-2-Clause-short": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-short": "Licensed under the BSD 3-Clause License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC-short": "Licensed under the ISC License.",
    "GPL-2.0-short": "under the GNU General Public License, version 2",
    "GPL-2.0-header": _GNU.format("General Public License") + "; either version 2 of the License",
    "GPL-2.0-only-header": _GNU.format("General Public License") + "; version 2 of the License",
    "LGPL-2.1-short": "under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-header": _GNU.format("Lesser General Public License") + "; either version 2.1 of the License",
    "LGPL-3.0-short": "under the GNU Lesser General Public License, version 3",
    "LGPL-header": "terms of the GNU Lesser General Public License as published by",
    "AGPL-3.0-short": "under the GNU Affero General Public License, version 3",
    "AGPL-header": "terms of the GNU Affero General Public License as published by",
    "GFDL-header": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "MPL-2.0-short": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "EPL-1.0-header": "are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0-header": "are made available under the terms of the Eclipse Public License v. 2.0",
    "EPL-2.0-short": "Licensed under the Eclipse Public License 2.0",
    "CDDL-1.0-header": "subject to the terms of the Common Development and Distribution License",
    "EUPL-1.2-header": "Licensed under the EUPL, Version 1.2",
    "Unlicense-short": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0-short": "Licensed under CC0 1.0.",
    "CC0-1.0-universal": "Creative Commons CC0 1.0 Universal",
    "CC0-1.0-waived": "has waived all copyright and related or neighboring rights to this work",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "ODbL-1.0": "This database is made available under the Open Database License",
}


def notices() -> dict[str, str]:
    found = dict(_NOTICES)
    for code, name in _CC.items():
        for version, port in _CC_VERSIONS.items():
            found[f"CC-{code}-{version}-short"] = f"Licensed under CC {code} {version}."
            if version != "4.0" or code not in ("BY", "BY-SA"):  # those two are in the first list
                old = name.replace("NoDerivatives", "NoDerivs") if version != "4.0" else name
                found[f"CC-{code}-{version}"] = f"This work is licensed under a Creative Commons {old} {version} {port} License."
    return found


def texts() -> dict[str, str]:
    """Full texts, with the suffix ``-text``."""
    return {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
