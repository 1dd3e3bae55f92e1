"""Files and folders on whatever file system a path names: existence, publishing, deletion.

Works from the driver and inside tasks alike, and needs no access to Spark's JVM.
"""

import uuid
from collections.abc import Iterator

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    system, place = file_system(path)
    return system.get_file_info(place).type != fs.FileType.NotFound


def names(path: str) -> list[str]:
    """Names in a folder; none if it is missing."""
    system, place = file_system(path)
    return [f.base_name for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True))]


def delete(path: str) -> bool:
    """Remove a folder with all in it; whether there was one."""
    system, place = file_system(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return False
    system.delete_dir(place)
    return True


def publish(staged: str, path: str) -> None:
    """Move a finished folder to its place, where readers see it whole or not at all."""
    system, place = file_system(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    system.move(file_system(staged)[1], place)


def move_file(source: str, target: str) -> None:
    system, place = file_system(target)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    system.move(file_system(source)[1], place)


def put(path: str, data: bytes) -> None:
    """Write one small file that appears whole. An object store does so by itself; a local file gets its name last."""
    system, place = file_system(path)
    folder, name = place.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    local = isinstance(system, fs.LocalFileSystem)
    staged = f"{folder}/_{name}-{uuid.uuid4().hex}" if local else place
    with system.open_output_stream(staged) as stream:
        stream.write(data)
    if local:
        system.move(staged, place)


def read(path: str) -> bytes:
    system, place = file_system(path)
    with system.open_input_stream(place) as stream:
        return stream.read()


def lines(path: str, size: int) -> Iterator[list[str]]:
    """Lines of a text file, each ended by a newline, some at a time: about ``size`` bytes are held, and the longest line."""
    system, place = file_system(path)
    with system.open_input_stream(place) as stream:
        rest = b""
        while block := stream.read(size):
            whole, newline, tail = block.rpartition(b"\n")
            if newline:
                yield (rest + whole).decode("utf-8").split("\n")
                rest = tail
            else:
                rest += block


def delete_file(path: str) -> bool:
    """Remove a file; whether it was there."""
    system, place = file_system(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return False
    system.delete_file(place)
    return True
