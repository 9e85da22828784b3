"""Working copies of repositories, kept by the git command on the driver."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from depweave.functions.paths import sanitise_url, slug_of, with_token


def local_path(url_or_id: str, repos_dir: str | Path) -> Path:
    """Where a repository's working copy lies."""
    graph_id = slug_of(url_or_id) if "://" in url_or_id or url_or_id.startswith("git@") else url_or_id
    return Path(repos_dir) / graph_id.replace("/", "__")


def _git(*arguments: str, cwd: Path | None = None, secret: str | None = None) -> str:
    done = subprocess.run(["git", *arguments], cwd=cwd, capture_output=True, text=True, errors="replace", check=False)
    if done.returncode:
        message = sanitise_url(done.stderr.replace(secret, "***") if secret else done.stderr)
        raise RuntimeError(f"git {arguments[0]} failed: {message.strip()}")
    return done.stdout.strip()


def default_branch(root: Path) -> str:
    """The remote's default branch, else the current one."""
    try:
        return _git("symbolic-ref", "--short", "refs/remotes/origin/HEAD", cwd=root).removeprefix("origin/")
    except RuntimeError:
        return _git("rev-parse", "--abbrev-ref", "HEAD", cwd=root)


def clone_or_fetch(url: str, dest: str | Path, branch: str | None = None, depth: int | None = None, force: bool = False, token: str | None = None, token_host: str = "", token_username: str = "") -> str:
    """Brings a working copy up to date and returns its branch.

    The token goes to the given host only and isn't left in the copy's settings.  A
    shallow copy is deepened when all history is asked for.
    """
    dest, source = Path(dest), with_token(url, token, token_host, token_username)
    if force and dest.exists():
        shutil.rmtree(dest)
    shallow = ["--depth", str(depth)] if depth else []
    if not (dest / ".git").exists():
        dest.parent.mkdir(parents=True, exist_ok=True)
        _git("clone", *shallow, *(["--branch", branch] if branch else []), source, str(dest), secret=token)
        _git("remote", "set-url", "origin", sanitise_url(url), cwd=dest)
        return branch or default_branch(dest)
    if not depth and _git("rev-parse", "--is-shallow-repository", cwd=dest) == "true":
        shallow = ["--unshallow"]
    name = branch or default_branch(dest)
    _git("fetch", *shallow, source, f"+refs/heads/{name}:refs/remotes/origin/{name}", cwd=dest, secret=token)
    _git("checkout", "-B", name, f"origin/{name}", cwd=dest)
    _git("reset", "--hard", f"origin/{name}", cwd=dest)
    return name
