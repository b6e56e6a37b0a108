"""Templates of public licenses: full texts from ``licenses/``, and the notices that name them.

A notice has the license's SPDX name, other wordings and passages of it a suffix, a full text
``-full``. Siblings and versions stand beside each other, so that the exact one wins by its words.
"""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).parent / "licenses"

CREATIVE_COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU = {
    "GPL": ("General Public License", ("1.0", "2.0", "3.0")),
    "LGPL": ("Lesser General Public License", ("2.1", "3.0")),
    "AGPL": ("Affero General Public License", ("1.0", "3.0")),
    "GFDL": ("Free Documentation License", ("1.1", "1.2", "1.3")),
}
NAMED = {
    "0BSD": "BSD Zero Clause License", "Artistic-1.0": "Artistic License 1.0", "Artistic-2.0": "Artistic License 2.0",
    "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0", "EPL-1.0": "Eclipse Public License, Version 1.0",
    "EPL-2.0": "Eclipse Public License, Version 2.0", "MPL-1.1": "Mozilla Public License, Version 1.1",
    "MPL-2.0": "Mozilla Public License, Version 2.0", "Apache-1.1": "Apache License, Version 1.1",
    "Apache-2.0": "Apache License, Version 2.0", "MIT": "MIT License", "ISC": "ISC License", "Zlib": "zlib License",
}

PASSAGES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    # The opening of both BSD licenses: the full texts tell them apart.
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _short(version: str) -> str:
    return version.removesuffix(".0")


def notices() -> dict[str, str]:
    found = dict(PASSAGES)
    for kind in CREATIVE_COMMONS:
        for version in CREATIVE_COMMONS_VERSIONS:
            found[f"CC-{kind}-{version}"] = f"Licensed under CC {kind} {version}."
            found[f"CC-{kind}-{version}-long"] = (
                f"licensed under a Creative Commons {CREATIVE_COMMONS[kind]} {version} International License."
            )
    for kind, (title, versions) in GNU.items():
        for version in versions:
            name = f"{kind}-{version}"
            found[name] = f"This work is licensed under the GNU {title}, version {_short(version)}."
            if kind == "GFDL":
                continue
            found[f"{name}-header"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                f"{title} as published by the Free Software Foundation, either version {_short(version)} of the "
                f"License, or (at your option) any later version."
            )
    found["LGPL-2.0"] = "This work is licensed under the GNU Library General Public License, version 2."
    for name, title in NAMED.items():
        if name != "Apache-2.0":
            found[f"{name}-licensed"] = f"Licensed under the {title}."
        if name != "MIT":
            found[f"{name}-released"] = f"Released under the {title}."
    return found


def templates() -> dict[str, str]:
    """Name and text of each template; a file's name is the license's."""
    texts = {f"{path.stem}-full": path.read_text(encoding="utf-8") for path in sorted(FOLDER.glob("*.txt"))}
    return notices() | texts
