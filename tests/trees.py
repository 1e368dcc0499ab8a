"""Small source trees as {path: source}."""

import os


def write(root, tree):
    for path, text in tree.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    return str(root)


SHOP = {
    "src/api/__init__.py": "",
    "src/api/checkout.py": "from payments.service import charge\n",
    "src/cycles/__init__.py": "",
    "src/cycles/a.py": "import cycles.b\n",
    "src/cycles/b.py": "import cycles.a\n",
    "src/payments/__init__.py": "",
    "src/payments/formatters/card.py": "from ..stripe import Card\n",
    "src/payments/formatters/plain.py": "",
    "src/payments/service.py": "from .stripe import pay\n",
    "src/payments/stripe.py": "import requests\n",
    "tests/analytics/test_reporting.py": "import analytics.reporting\n",
    "tests/api/test_checkout.py": "from api.checkout import run\n",
    "tests/helpers_test.py": "import pytest\n",
    "tests/payments/test_stripe.py": "from payments.stripe import pay\n",
}
