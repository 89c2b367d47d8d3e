"""``python -m tamarack.service.cli serve``"""

from __future__ import annotations

import argparse
import os

from tamarack.service.handlers import Service, Settings
from tamarack.service.server import make_server


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarack", description="Vector and hybrid retrieval on Spark")
    serve = p.add_subparsers(dest="command", required=True).add_parser("serve", help="run the HTTP service")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8000)
    serve.add_argument("--data-dir", default=None, help="before VK_DATA_DIR, then ./data")
    return p


def main(argv: list[str] | None = None) -> None:
    options = parser().parse_args(argv)
    from tamarack.session import local_session

    service = Service(local_session(os.cpu_count() or 4), Settings(data_dir=options.data_dir))
    server = make_server(service, options.host, options.port)
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.shutdown()


if __name__ == "__main__":
    main()
